import pytest

from fileglade.operators.rollup import RollupTooWide
from fileglade.plans.browser import CatalogBrowser
from fileglade.schema import CATALOG_SCHEMA_NS
from fileglade.sinks.listings import ListingStore
from fileglade.sources.snapshots import SnapshotStore

FIRST = "files_2031-02-03_04_05_06_UTC"
SECOND = "files_2031-02-03_16_00_00_UTC"


def files(count, folder="/p/"):
    rows = [(folder, f"f{i:03d}", "FILE", i, i, 10**18 + i, None) for i in range(count)]
    return rows + [("/", "p", "DIR"), ("/p/", "sub", "DIR"), ("/p/sub/", "x", "FILE", 1000, 1, 5, 5)]


@pytest.fixture
def store(spark, make, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), CATALOG_SCHEMA_NS)
    store.publish_live(make(files(1)))
    store.publish(make(files(30)), FIRST)
    return store


def test_listing_request(spark, make, store):
    browser = CatalogBrowser(spark, store)
    shown = browser.listing("p", page=2, page_size=20, sort="size", order="desc")
    assert (shown.path, shown.snapshot) == ("/p/", FIRST)
    assert (shown.page.number, shown.page.pages, shown.listing.total_rows) == (2, 2, 31)
    assert shown.listing.total_dirs == 1 and shown.entries.count() == 11
    store.publish(make(files(40)), SECOND)
    newer = browser.listing("/p/", type="file", name_filter="f03")
    assert (newer.snapshot, newer.listing.total_rows) == (SECOND, 10)


def test_rollup_request(spark, store):
    browser = CatalogBrowser(spark, store)
    result = browser.rollup("/p")
    assert (result.path, result.snapshot, result.rows_scanned) == ("/p/", FIRST, 31)
    assert result.total_children == 2 and not result.children_truncated()
    assert [c["name"] for c in result.children().collect()] == ["sub", "."]
    assert result.children_truncated(1) and result.children(1).count() == 1
    assert result.totals().first()["file_count"] == 31
    row = result.envelope(1).first()
    assert (row["total_children"], row["children_truncated"], len(row["children"])) == (2, True, 1)


def test_rollup_limits(spark, store):
    with pytest.raises(PermissionError):
        CatalogBrowser(spark, store).rollup("/")
    assert CatalogBrowser(spark, store, allow_root=True).rollup("/").total_children == 1
    with pytest.raises(RollupTooWide):
        CatalogBrowser(spark, store, max_groups=1).rollup("/p")


def test_unpinned_and_unusable_snapshots_read_live(spark, store):
    assert CatalogBrowser(spark, store, pin=False).listing("/p/").listing.total_rows == 2
    browser = CatalogBrowser(spark, store, newest=lambda: SECOND)
    shown = browser.listing("/p/")
    assert (shown.snapshot, shown.listing.total_rows) == (None, 2)


def test_ready_listings_are_used_and_complete(spark, store, tmp_path):
    listings = ListingStore(spark, str(tmp_path / "ready"), 4, CATALOG_SCHEMA_NS)
    browser = CatalogBrowser(spark, store, listings)
    assert listings.directory(FIRST, "/p/") is None
    catalog, _ = store.read(FIRST)
    wanted = spark.createDataFrame([("/p/",)], "path string")
    listings.add(catalog, wanted, FIRST, "one")
    ready = listings.directory(FIRST, "/p/")
    assert ready.count() == 31 and listings.directory(FIRST, "/p/sub/") is None
    shown = browser.listing("/p/", type="file")
    assert shown.listing.total_rows == 30
    assert all("ready" in f for f in shown.listing.rows.inputFiles())
    direct = browser.listing("/p/sub/")
    assert direct.listing.total_rows == 1
    more = spark.createDataFrame([("/p/",), ("/p/sub/",)], "path string")
    listings.add(catalog, more, FIRST, "two")
    listings.add(catalog, more, FIRST, "two")
    assert listings.rows(FIRST).count() == 32
    assert listings.ready().count() == 2


def test_prepare_skips_what_is_ready(spark, store, tmp_path):
    listings = ListingStore(spark, str(tmp_path / "ready"), 4, CATALOG_SCHEMA_NS)
    browser = CatalogBrowser(spark, store, listings)
    assert [r["path"] for r in browser.to_fetch("/p").collect()] == ["/p/sub/"]
    assert browser.prepare(["/p"], 0) == FIRST
    assert browser.prepare(["/p"], 1) == FIRST
    parts = {(r["path"], r["part"]) for r in listings.ready().collect()}
    assert {p for p, _ in parts} == {"/p/", "/p/sub/"} and len(parts) == 2
    assert browser.to_fetch("/p").count() == 0
    unpinned = CatalogBrowser(spark, store, listings, pin=False)
    assert unpinned.prepare(["/p"]) is None and unpinned.to_fetch("/").count() == 1


def test_tree_and_annotated_page(spark, store):
    browser = CatalogBrowser(spark, store)
    assert [r["path"] for r in browser.tree("/").collect()] == ["/p/"]
    shown = browser.listing("/p")
    rows = browser.annotated(shown, browser.rollup("/p")).where("element_type = 'DIR'").collect()
    assert [(r["name"], r["rollup_bytes"], r["rollup_state"]) for r in rows] == [("sub", 1000, "stats")]
    assert browser.annotated(shown, None).where("rollup_state = 'none'").count() == 1


def test_exports(spark, store, tmp_path):
    browser = CatalogBrowser(spark, store, listing_cap=5)
    out = browser.export_listing("/p/", str(tmp_path / "out"))
    assert out.endswith("listing-p-TRUNCATED")
    assert spark.read.csv(out, header=True).count() == 5
    rolled = browser.export_rollup("/p/", str(tmp_path / "out"))
    assert spark.read.csv(rolled, header=True).count() == 2
