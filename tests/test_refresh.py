import time

import pytest
from pyspark.errors import StreamingQueryException

from fileglade.operators.rollup import rollup_groups
from fileglade.plans.browser import CatalogBrowser
from fileglade.schema import CATALOG_SCHEMA_NS
from fileglade.sources.snapshots import SnapshotStore
from fileglade.streaming.refresh import RefreshPlan, SnapshotRefresh

FIRST = "files_2031-02-03_04_05_06_UTC"
SECOND = "files_2031-02-03_16_00_00_UTC"


def tree(count):
    rows = [("/", "p", "DIR"), ("/p/", "a", "DIR"), ("/p/", "void", "DIR")]
    return rows + [("/p/a/", f"f{i}", "FILE", i, i, i, i) for i in range(count)]


def run(refresh, checkpoint):
    query = refresh.start(str(checkpoint))
    assert query.awaitTermination(120)
    assert query.exception() is None


def contents(frame):
    return sorted(map(tuple, frame.collect()))


def test_refresh_follows_snapshots_and_replays_cleanly(spark, make, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), CATALOG_SCHEMA_NS)
    plan = RefreshPlan(rollups=[("/", 1), ("/p/", 1)], roots=["/p/"], depth=1)
    refresh = SnapshotRefresh(spark, store, str(tmp_path / "out"), plan, shards=2)
    run(refresh, tmp_path / "progress")
    assert refresh.current() is None and refresh.rollups(FIRST).count() == 0
    store.publish(make(tree(3)), FIRST)
    run(refresh, tmp_path / "progress")
    assert refresh.current() == FIRST

    store.publish(make(tree(5)), SECOND)
    run(refresh, tmp_path / "progress")
    assert refresh.current() == SECOND
    for name in (FIRST, SECOND):
        catalog, _ = store.read(name)
        got = refresh.rollups(name).where(f"snapshot = '{name}' and prefix = '/p/'")
        single = rollup_groups(catalog, "/p/", 1)
        assert contents(got.select(*single.columns)) == contents(single)
        ready = refresh.listings.directory(name, "/p/a/")
        assert ready.count() == (3 if name == FIRST else 5)

    browser = CatalogBrowser(spark, store, refresh=refresh)
    kept, direct = browser.rollup("/p"), CatalogBrowser(spark, store).rollup("/p")
    assert contents(kept.groups) == contents(direct.groups)
    assert (kept.rows_scanned, kept.snapshot) == (5, SECOND)
    assert refresh.groups(SECOND, "/p/", 2) is None and refresh.groups("x", "/p/", 1) is None

    def outputs():
        return [
            contents(part)
            for name in (FIRST, SECOND)
            for part in (
                refresh.rollups(name),
                refresh.listings.rows(name).select("snapshot", "parent_path", "name"),
                refresh.listings.ready(name),
            )
        ]

    before = outputs()
    run(refresh, tmp_path / "a new checkpoint replays everything")
    assert outputs() == before and all(before)


def test_an_interrupted_refresh_is_completed(spark, make, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path / "store"), CATALOG_SCHEMA_NS)
    plan = RefreshPlan(rollups=[("/p/", 1)], roots=["/p/"], depth=1)
    refresh = SnapshotRefresh(spark, store, str(tmp_path / "out"), plan, shards=2)
    store.publish(make(tree(3)), FIRST)

    def fails(*_args, **_kw):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(refresh.listings, "add", fails)
        query = refresh.start(str(tmp_path / "progress"))
        with pytest.raises(StreamingQueryException):
            query.awaitTermination(120)
    assert refresh.current() is None and refresh.groups(FIRST, "/p/", 1) is None
    run(refresh, tmp_path / "progress")
    assert refresh.current() == FIRST
    assert refresh.listings.directory(FIRST, "/p/a/").count() == 3
    assert refresh.groups(FIRST, "/p/", 1).count() == 2


def test_polling_trigger(spark, make, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), CATALOG_SCHEMA_NS)
    refresh = SnapshotRefresh(spark, store, str(tmp_path / "out"), RefreshPlan([("/p/", 1)]))
    query = refresh.start(str(tmp_path / "progress"), every="1 second")
    try:
        store.publish(make(tree(2)), FIRST)
        deadline = time.monotonic() + 60
        while refresh.current() != FIRST and time.monotonic() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    assert refresh.current() == FIRST


def test_announced_but_unusable_snapshots_are_skipped(spark, make, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), CATALOG_SCHEMA_NS)
    store.publish(make(tree(2)), FIRST)
    spark.createDataFrame([(SECOND,)], "value string").write.mode("append").text(store.announcements)
    refresh = SnapshotRefresh(spark, store, str(tmp_path / "out"), RefreshPlan([("/p/", 1)]))
    run(refresh, tmp_path / "progress")
    assert refresh.current() == FIRST


def test_a_grown_plan_is_refreshed_again(spark, make, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), CATALOG_SCHEMA_NS)
    store.publish(make(tree(4)), FIRST)
    small = SnapshotRefresh(spark, store, str(tmp_path / "out"), RefreshPlan([("/", 1)]))
    run(small, tmp_path / "progress")
    assert small.groups(FIRST, "/", 1) is not None
    grown = SnapshotRefresh(spark, store, str(tmp_path / "out"), RefreshPlan([("/", 1), ("/p/", 1)], roots=["/p/"]))
    assert grown.groups(FIRST, "/p/", 1) is None  # not stored yet: the caller computes it
    browser = CatalogBrowser(spark, store, refresh=grown)
    assert contents(browser.rollup("/p").groups) == contents(CatalogBrowser(spark, store).rollup("/p").groups)
    run(grown, tmp_path / "progress2")
    catalog, _ = store.read(FIRST)
    single = rollup_groups(catalog, "/p/", 1)
    assert contents(grown.groups(FIRST, "/p/", 1).select(*single.columns)) == contents(single)
    assert grown.listings.directory(FIRST, "/p/a/").count() == 4


def test_later_snapshots_start_from_the_last_result(spark, make, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), CATALOG_SCHEMA_NS)
    plan = RefreshPlan([("/", 1), ("/p/", 2)])
    refresh = SnapshotRefresh(spark, store, str(tmp_path / "out"), plan)
    store.publish(make(tree(6)), FIRST)
    run(refresh, tmp_path / "progress")
    changed = [r for r in tree(6) if r[1] not in ("f5", "f0")] + [("/p/void/", "new", "FILE", 9, 9, 9, 9)]
    store.publish(make(changed), SECOND)
    assert refresh._previous(SECOND) == FIRST
    run(refresh, tmp_path / "progress")
    catalog, _ = store.read(SECOND)
    for prefix, depth in plan.rollups:
        single = rollup_groups(catalog, prefix, depth)
        got = refresh.groups(SECOND, prefix, depth)
        assert contents(got.select(*single.columns)) == contents(single)
