"""Pages from the rank index equal pages sorted from the whole directory."""

import pytest

from fileglade.operators import listing
from fileglade.schema import CATALOG_SCHEMA
from fileglade.sinks.rank_index import indexed_page, rank_index
from fileglade.sources.catalog import read_catalog, sorted_layout


@pytest.fixture(scope="module")
def layered(spark, stored, tmp_path_factory):
    """The stored catalog rewritten over many files, so that directories span several."""
    path = str(tmp_path_factory.mktemp("layered") / "table")
    sorted_layout(stored.repartition(13)).write.parquet(path)
    table = read_catalog(spark, path)
    return table, rank_index(table).cache()


@pytest.mark.parametrize("path", ["/events/", "/documents/", "/", "/no/such/"])
@pytest.mark.parametrize("page,size", [(1, 20), (3, 37), (10**6, 100), (2, 100)])
def test_pages_equal_sorted_pages(spark, layered, path, page, size):
    table, index = layered
    got, at = indexed_page(spark, index, CATALOG_SCHEMA, path, page, size)
    want, expected = listing.open_listing(table, path).page(page, size)
    assert at == expected
    assert [tuple(r) for r in got.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]


def test_directories_span_files(layered):
    _, index = layered
    spread = index.groupBy("parent_path").count().where("count > 1").count()
    assert spread > 0
