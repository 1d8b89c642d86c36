"""The physical plans that make the operators cheap on a big table."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from fileglade.operators import hierarchy as H
from fileglade.operators import listing as L
from fileglade.operators import rollup as R
from fileglade.plans import browser
from fileglade.sources import catalog as C


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_directory_scan_is_pushed_down_and_pruned(stored):
    text = plan(C.directory_rows(stored, "/documents", "file", "doc"))
    for pushed in ("EqualTo(parent_path,/documents/)", "EqualTo(element_type,FILE)", "StringContains(name,doc)"):
        assert pushed in text
    rows = C.directory_rows(stored, "/documents", columns=["name"])
    assert "ReadSchema: struct<parent_path:string,name:string>" in plan(rows)


def test_subtree_scan_is_pushed_down(stored):
    text = plan(C.subtree_files(stored, "/lineitem/"))
    assert "StringStartsWith(parent_path,/lineitem/)" in text
    assert "owner_name" not in text.split("ReadSchema")[1]


def test_rollup_has_one_shuffle_and_reads_no_file_names(stored):
    groups = R.rollup_groups(stored, "/lineitem/", 2)
    text = plan(R.children(groups, 500))
    assert text.count("Exchange") == 1 and "Join" not in text
    assert "partial_sum" in text and "TakeOrderedAndProject" in text
    files, seeds = text.split("FileScan")[1:]
    assert "StringStartsWith(parent_path,/lineitem/)" in files
    assert "EqualTo(parent_path,/lineitem/)" in seeds and "EqualTo(element_type,DIR)" in seeds
    assert "name" not in files.split("ReadSchema: ")[1].split(">")[0]


def test_many_rollups_scan_files_once_and_join_by_equality(stored):
    text = plan(R.rollup_many(stored, [("/lineitem/", 1), ("/documents/", 2)]))
    assert text.count("FileScan") == 2 and "BroadcastHashJoin" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_page_is_a_top_k(stored):
    found = L.open_listing(stored, "/events/")
    rows, _ = found.page(2, 20, "size", "desc")
    text = plan(rows)
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_cap_is_a_pushed_filter(stored):
    found = L.open_listing(stored, "/events/", cap=100)
    text = plan(found.rows)
    assert "LessThanOrEqual(name," in text and "Limit" not in text


def test_frontier_is_planned_without_a_job(stored):
    tracker = stored.sparkSession.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    near = plan(H.frontier(stored, ["/lineitem/", "/documents/"], 1))
    assert "Exchange" not in near and "Join" not in near
    assert "LeftAnti" in plan(H.frontier(stored, ["/lineitem/", "/documents/"], 2))
    assert set(tracker.getJobIdsForGroup()) == before


def test_deep_pages_come_from_a_range_sort(stored):
    found = L.open_listing(stored, "/events/")
    near, at = found.page(4, 20, "size", "desc")
    deep = dataclasses.replace(found, deep_page_rows=10)
    rows, again = deep.page(4, 20, "size", "desc")
    assert again == at and rows.collect() == near.collect()
    last, end = deep.page(10**6, 20)
    assert last.count() == found.total_rows - end.offset


def test_first_children_are_cut_before_the_shuffle(stored):
    text = plan(H.first_children(stored))
    assert text.count("WindowGroupLimit") == 2


def test_no_python_anywhere(stored):
    groups = R.guarded(R.rollup_groups(stored, "/lineitem/", 1))
    frames = [
        R.with_share(R.children(groups)),
        browser.envelope(R.children(groups), R.totals(groups), path="/lineitem/"),
        R.rollup_all_directories(stored),
        H.tree_levels(stored),
        L.entries(C.directory_rows(stored, "/documents/")),
        H.breadcrumbs(stored.select(F.col("parent_path").alias("path"))),
    ]
    for frame in frames:
        text = plan(frame)
        assert "EvalPython" not in text and "PythonUDF" not in text and "Cartesian" not in text


def test_sorted_layout_splits_a_hot_directory(spark):
    rows = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, '/hot/', concat('/d', id % 50, '/')) as parent_path",
        "lpad(id, 8, '0') as name",
    )
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        parts = C.sorted_layout(rows).where("parent_path = '/hot/'")
        held = parts.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset(key)
    assert len(held) > 1 and sum(r["count"] for r in held) == 6667


@pytest.mark.parametrize("path", ["/events/", "/lineitem/"])
def test_sorted_layout_keeps_every_row(stored, path):
    laid = C.sorted_layout(stored)
    below = F.col("parent_path").startswith(path)
    assert laid.where(below).count() == stored.where(below).count()
