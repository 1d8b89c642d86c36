import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fileglade.schema import CATALOG_SCHEMA_NS
from fileglade.sources.catalog import read_catalog
from fileglade.sources.snapshots import SnapshotStore, newest_snapshot

FIRST = "files_2031-02-03_04_05_06_UTC"
SECOND = "files_2031-02-03_16_00_00_UTC"
THIRD = "files_2031-02-04_10_20_30_UTC"


def test_newest_snapshot_of_a_listing(spark):
    names = [f".snapshot/{FIRST}/", f".snapshot/{THIRD}/", f"{SECOND}", "/zzz_2030/"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    assert newest_snapshot(frame, "files_").first()["snapshot"] == THIRD
    assert newest_snapshot(frame).first()["snapshot"] == "zzz_2030"
    assert newest_snapshot(frame.limit(0), "files_").first()["snapshot"] is None


@pytest.fixture
def store(spark, make, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"), CATALOG_SCHEMA_NS)


def test_publish_pin_and_fall_back(make, store, tmp_path):
    store.publish_live(make([("/", "live", "FILE", 1, 1, 1, 1)]))
    assert store.newest() is None
    store.publish(make([("/", "one", "FILE", 1, 1, 1, 1)]), FIRST)
    store.publish(make([("/", "two", "FILE", 1, 1, 1, 1)]), SECOND)
    assert store.names() == [FIRST, SECOND] and store.newest("files_") == SECOND
    assert store.newest("other_") is None

    rows, source = store.read(FIRST)
    assert source == FIRST
    assert [(r["name"], r["snapshot"]) for r in rows.collect()] == [("one", FIRST)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan
    assert f"snapshot={SECOND}" not in " ".join(rows.inputFiles())

    for wanted in (THIRD, None):
        rows, source = store.read(wanted)
        assert source is None
        assert [(r["name"], r["snapshot"]) for r in rows.collect()] == [("live", None)]


def test_an_unfinished_snapshot_is_not_used(make, store, tmp_path):
    store.publish_live(make([("/", "live", "FILE", 1, 1, 1, 1)]))
    store.publish(make([("/", "one", "FILE", 1, 1, 1, 1)]), FIRST)
    half = tmp_path / "store" / "snapshots" / f"snapshot={SECOND}"
    half.mkdir()
    pq.write_table(pa.table({"name": ["half"]}), half / "part-0.parquet")
    assert store.newest() == FIRST
    assert store.read(SECOND)[1] is None


def test_snapshot_names_are_checked(make, store):
    with pytest.raises(ValueError):
        store.publish(make([("/", "x", "FILE")]), "../evil")


def test_snapshots_are_written_once(make, store):
    store.publish(make([("/", "x", "FILE")]), FIRST)
    with pytest.raises(FileExistsError):
        store.publish(make([]), FIRST)
    assert store.read(FIRST)[0].count() == 1


def test_nanosecond_parquet_times(spark, tmp_path):
    nanos = 1_712_345_678_987_654_321
    columns = {
        "parent_path": ["/"],
        "name": ["a"],
        "element_type": ["FILE"],
        "size": [1],
        "used": [1],
        "mtime": pa.array([nanos], pa.timestamp("ns")),
        "atime": pa.array([-1], pa.timestamp("ns")),
        "owner_name": ["u"],
        "extension": [""],
        "nlinks": [1],
    }
    pq.write_table(pa.table(columns), tmp_path / "t.parquet", version="2.6")
    row = read_catalog(spark, str(tmp_path / "t.parquet"), CATALOG_SCHEMA_NS).first()
    assert (row["mtime"], row["atime"]) == (nanos, -1)


def test_microsecond_times_sort_and_print(spark, make):
    moment = datetime.datetime(2024, 1, 1, 12, 0, 0, 5)
    rows = make([("/", "a", "FILE", 1, 1, moment, None)], nanos=False)
    assert rows.select(F.max("mtime")).first()[0] == moment
