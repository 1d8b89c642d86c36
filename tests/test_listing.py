import math

import pytest
from pyspark.sql import functions as F

from fileglade.operators import listing as L
from fileglade.operators.ordering import first_per_group, nth_smallest
from fileglade.sources import catalog as C


@pytest.fixture(scope="module")
def flat(make):
    rows = [("/big/", f"f{i:05d}.dat", "FILE", (i * 7919) % 1000, i) for i in range(3000)]
    rows += [("/big/", f"run-{i:02d}", "DIR", 1, 1) for i in range(10)]
    rows += [("/big/", "link-1", "SYMLINK", 1, 1), ("/big/", "odd", None, 1, 1)]
    rows += [("/big/sub/", "inner", "FILE", 1, 1), ("/bigger/", "other", "FILE", 1, 1)]
    rows += [("/text/", n, "FILE", 1, 1) for n in ("50%off", "50xoff", "a_b", "aXb", "Ab", "😀")]
    return make(rows).cache()


def names(rows):
    return [r["name"] for r in rows.collect()]


@pytest.mark.parametrize(
    "given, size", [(None, 20), (5, 20), (50, 50), (5000, 100), (0, 20), (-3, 20)]
)
def test_page_size_is_clamped(given, size):
    assert L.page_of(1000, 1, given).size == size


@pytest.mark.parametrize(
    "total, page, number, pages",
    [(0, 3, 1, 1), (41, 3, 3, 3), (41, 10**6, 3, 3), (41, 0, 1, 3), (41, -1, 1, 3), (41, None, 1, 3)],
)
def test_page_number_is_clamped(total, page, number, pages):
    at = L.page_of(total, page, 20)
    assert (at.number, at.pages) == (number, pages)


def test_pages_do_not_overlap(flat):
    found = L.open_listing(flat, "/big")
    seen = []
    for number in (1, 2, 3):
        rows, at = found.page(number, 100)
        seen += names(rows)
        assert at.pages == math.ceil(found.total_rows / 100)
    assert len(seen) == len(set(seen)) == 300


def test_directories_come_first_both_ways(flat):
    found = L.open_listing(flat, "/big/")
    up, _ = found.page(1, 20)
    down, _ = found.page(1, 20, order="desc")
    assert [r["element_type"] for r in up.collect()][:10] == ["DIR"] * 10
    assert names(down)[:11] == [f"run-{i:02d}" for i in range(9, -1, -1)] + ["link-1"]


def test_counts_and_types(flat):
    found = L.open_listing(flat, "/big/")
    assert (found.total_rows, found.total_dirs, found.total_files, found.total_other) == (
        3012, 10, 3000, 2,
    )
    other = L.open_listing(flat, "/big/", "other")
    assert sorted(names(other.rows)) == ["link-1", "odd"]
    assert L.open_listing(flat, "/big/", "dir").total_rows == 10
    assert L.open_listing(flat, "/big/", "file").total_rows == 3000
    with pytest.raises(ValueError):
        L.open_listing(flat, "/big/", "folders")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("50%", ["50%off"]),
        ("a_b", ["a_b"]),
        ("ab", []),
        ("  Ab ", ["Ab"]),
        ("😀", ["😀"]),
        ("   ", ["50%off", "50xoff", "Ab", "aXb", "a_b", "😀"]),
    ],
)
def test_name_filter_is_a_literal_substring(flat, text, expected):
    assert sorted(names(L.open_listing(flat, "/text/", name_contains=text).rows)) == expected


def test_cap_keeps_the_first_names(flat):
    found = L.open_listing(flat, "/big/", cap=1000)
    assert found.truncated and found.total_rows == 1000 and found.total_dirs == 0
    assert sorted(names(found.rows)) == [f"f{i:05d}.dat" for i in range(1000)]
    rows, at = found.page(10**6, 20)
    assert at.pages == 50 and rows.count() == 20
    exact = L.open_listing(flat, "/big/", cap=3012)
    assert not exact.truncated and exact.total_rows == 3012


def test_filter_escapes_the_cap(flat):
    found = L.open_listing(flat, "/big/", name_contains="f0001", cap=1000)
    assert not found.truncated and found.total_rows == 10


def test_unknown_directory_is_empty(flat):
    found = L.open_listing(flat, "/no/such/dir")
    rows, at = found.page(1)
    assert (found.total_rows, at.pages, rows.count()) == (0, 1, 0)


@pytest.mark.parametrize("sort", ["size", "mtime", "atime", "owner_name", "nonsense"])
@pytest.mark.parametrize("order", ["asc", "desc", "sideways"])
def test_sorts_put_nulls_last(make, sort, order):
    rows = [
        ("/d/", "c", "FILE", 3, 0, 30, None),
        ("/d/", "a", "FILE", None, 0, None, 7),
        ("/d/", "b", "DIR", 3, 0, 30, 9),
        ("/d/", "d", "FILE", 1, 0, 10, 8),
    ]
    found = L.open_listing(make(rows), "/d/")
    got = names(found.sorted_rows(sort, order))
    key = sort if sort in ("size", "mtime", "atime", "owner_name") else "name"
    data = {r["name"]: r for r in found.rows.collect()}
    if key == "name":
        expected = ["b", *sorted("acd", reverse=order == "desc")]
    else:
        sign = -1 if order == "desc" else 1

        def place(name):
            row = data[name]
            value = row[key] if not isinstance(row[key], str) else 0
            missing = value is None
            return (missing, sign * (value or 0), row["element_type"] != "DIR", name)

        expected = sorted(data, key=place)
    assert got == expected


def test_entries_format_times(make):
    rows = make([("/d/", "a", "FILE", 1, 1, 1_712_345_678_987_654_321, None)])
    entry = L.entries(C.directory_rows(rows, "/d/")).first()
    assert (entry["mtime"], entry["atime"]) == ("2024-04-05T19:34:38.987654321", "")


@pytest.mark.parametrize("n", [1, 2, 499, 500, 501, 2999, 3000])
@pytest.mark.parametrize("picks", [3, 40, 100_000])
def test_nth_smallest_narrows_exactly(flat, n, picks):
    rows = flat.where((F.col("parent_path") == "/big/") & (F.col("element_type") == "FILE"))
    got = nth_smallest(rows, "name", n, total=3000, small=20, picks=picks)
    assert got == f"f{n - 1:05d}.dat"


def test_nth_smallest_with_repeated_keys(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 900, "m").otherwise("z").alias("k"))
    for n, value in ((1, "m"), (900, "m"), (901, "z"), (1000, "z")):
        assert nth_smallest(rows, "k", n, total=1000, small=10, picks=50) == value
    with pytest.raises(ValueError):
        nth_smallest(rows, "k", 1001, total=1000)


@pytest.mark.parametrize("threshold", [1000, 2])
def test_first_per_group_with_a_hot_group(spark, threshold):
    rows = spark.range(5000).selectExpr(
        "if(id % 10 < 7, 'hot', concat('g', id % 50)) as g", "lpad(id, 6, '0') as name"
    )
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(key, str(threshold))
    try:
        got = first_per_group(rows, ["g"], [F.col("name")], 5, salt=F.col("name"))
        result = sorted((r["g"], r["position"], r["name"]) for r in got.collect())
    finally:
        spark.conf.unset(key)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["g"], []).append(r["name"])
    expected = sorted(
        (g, i, n) for g, ns in groups.items() for i, n in enumerate(sorted(ns)[:5], start=1)
    )
    assert result == expected
