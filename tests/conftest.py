import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fileglade.schema import CATALOG_SCHEMA, CATALOG_SCHEMA_NS  # noqa: E402
from fileglade.sources.catalog import read_catalog, sorted_layout  # noqa: E402
from fileglade.sources.derived import derived_catalog  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """The derived catalog as a sorted Parquet table."""
    path = str(tmp_path_factory.mktemp("catalog") / "table")
    sorted_layout(derived_catalog(spark, SF)).write.parquet(path)
    return read_catalog(spark, path)


@pytest.fixture(scope="session")
def make(spark):
    """Catalog rows from short tuples: (parent, name, type, size, used, mtime_ns, atime_ns)."""

    def build(rows, nanos=True):
        schema = CATALOG_SCHEMA_NS if nanos else CATALOG_SCHEMA
        full = [
            (*row, *[None] * (7 - len(row)), "user", "", 1) for row in rows
        ]
        return spark.createDataFrame(full, schema)

    return build
