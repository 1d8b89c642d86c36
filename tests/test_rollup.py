import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from fileglade.operators import rollup as R

STUDIO = [
    ("/studio/reels/", "r1.mov", "FILE", 120, 128, 2_500, 4_000),
    ("/studio/reels/raw/takes/", "t1.mov", "FILE", 40, 64, 7_700, 1_500),
    ("/studio/stills/", "s1.jpg", "FILE", 15, 16, 800, 900),
    ("/studio/reels/", "r2.mov", "FILE", 310, 320, 4_200, 6_600),
    ("/studio/", "notes.txt", "FILE", 9, 12, 300, 350),
    ("/studioline/q/", "other.bin", "FILE", 777, 784, 88_888, 88_888),
    ("/studio/", "reels", "DIR", 4096, 4096, 10**6, 10**6),
    ("/studio/", "stills", "DIR", 4096, 4096, 10**6, 10**6),
    ("/studio/", "empty", "DIR", 4096, 4096, 10**6, 10**6),
    ("/studio/reels/", "raw", "DIR", 4096, 4096, 10**6, 10**6),
    ("/studio/reels/raw/", "takes", "DIR", 4096, 4096, 10**6, 10**6),
    ("/studio/reels/", "shortcut", "SYMLINK", 3, 3, 10**6, 10**6),
]


def by_name(groups):
    return {
        r["name"]: (r["file_count"], r["total_bytes"], r["total_used"], r["mtime"], r["atime"])
        for r in groups.collect()
    }


def test_depth_one(make):
    assert by_name(R.rollup_groups(make(STUDIO), "/studio/", 1)) == {
        "reels": (3, 470, 512, 7_700, 6_600),
        "stills": (1, 15, 16, 800, 900),
        ".": (1, 9, 12, 300, 350),
        "empty": (0, 0, 0, None, None),
    }


def test_depth_two_keeps_depth_one_seeds(make):
    groups = by_name(R.rollup_groups(make(STUDIO), "/studio/", 2))
    assert groups == {
        "reels": (2, 430, 448, 4_200, 6_600),
        "reels/raw": (1, 40, 64, 7_700, 1_500),
        "stills": (1, 15, 16, 800, 900),
        ".": (1, 9, 12, 300, 350),
        "empty": (0, 0, 0, None, None),
    }
    only_deep = make([("/x/A/1/", "f", "FILE", 1, 1, 1, 1), ("/x/", "A", "DIR", 0, 0, 0, 0)])
    assert {n: g[0] for n, g in by_name(R.rollup_groups(only_deep, "/x/", 2)).items()} == {
        "A": 0,
        "A/1": 1,
    }


def test_null_sizes_count_and_null_times_pass(make):
    rows = make(
        [("/w/k/", "p", "FILE", 64, 60, None, 5), ("/w/k/", "q", "FILE", None, None, 4_100, None)]
    )
    assert by_name(R.rollup_groups(rows, "/w/", 1)) == {"k": (2, 64, 60, 4_100, 5)}
    blank = make([("/w/k/", "p", "FILE"), ("/w/", "z", "DIR")])
    shown = {r["name"]: r for r in R.children(R.rollup_groups(blank, "/w/", 1)).collect()}
    assert (shown["k"]["file_count"], shown["k"]["total_bytes"]) == (1, 0)
    assert (shown["z"]["last_modified"], shown["z"]["last_accessed"]) == ("", "")


def test_many_rollups_equal_single_ones(stored):
    requests = [("/", 1), ("/", 3), ("/lineitem/", 2), ("/documents", 1), ("/home/", 1)]
    requests.append(("/nix/", 1))
    many = R.rollup_many(stored, requests).collect()
    for prefix, depth in requests:
        prefix = R.normalize_prefix(prefix)
        single = sorted(map(tuple, R.rollup_groups(stored, prefix, depth).collect()))
        part = sorted(
            tuple(r)[2:] for r in many if r["prefix"] == prefix and r["depth"] == depth
        )
        assert [s[:4] for s in part] == [s[:4] for s in single]
        assert part == single


def test_many_rollups_of_one_long_request_list(make):
    requests = [(f"/studio/{i}/", 1) for i in range(50)] + [("/studio/", 1)]
    many = R.rollup_many(make(STUDIO), requests)
    kept = many.where(F.col("prefix") == "/studio/").drop("prefix", "depth")
    assert by_name(kept) == by_name(R.rollup_groups(make(STUDIO), "/studio/", 1))
    assert many.count() == kept.count()


def test_merging_group_states(make):
    one = R.rollup_groups(make(STUDIO[:3]), "/studio/", 1)
    two = R.rollup_groups(make(STUDIO[3:]), "/studio/", 1)
    merged = R.merge_groups(one.unionByName(two), ["name"])
    assert by_name(merged) == by_name(R.rollup_groups(make(STUDIO), "/studio/", 1))


def test_all_directories_equal_single_totals(stored):
    every = {r["path"]: r for r in R.rollup_all_directories(stored).collect()}
    for prefix in ("/", "/lineitem/", "/lineitem/A/", "/documents/", "/events/", "/home/empty/"):
        total = R.totals(R.rollup_groups(stored, prefix, 1)).first()
        assert every[prefix]["file_count"] == total["file_count"]
        assert every[prefix]["total_bytes"] == total["total_bytes"]
        assert every[prefix]["total_used"] == total["total_used"]
    assert every["/lineitem/empty/"]["file_count"] == 0


def test_total_equals_direct_sum(stored):
    files = stored.where("element_type = 'FILE' and parent_path like '/documents/%'")
    direct = files.selectExpr("count(*)", "sum(size)", "sum(used)").first()
    total = R.totals(R.rollup_groups(stored, "/documents/", 2)).first()
    assert tuple(total)[:3] == tuple(direct)


def test_request_checks():
    with pytest.raises(PermissionError):
        R.check_request("/", 1)
    assert R.check_request("", 1, allow_root=True) == "/"
    for depth in (0, 9):
        with pytest.raises(ValueError):
            R.check_request("/a", depth)


def test_width_guard(make):
    rows = make(
        [("/x/a/", "1", "FILE", 1, 1), ("/x/b/", "2", "FILE", 1, 1), ("/x/", "seed", "DIR", 1, 1)]
    )
    groups = R.rollup_groups(rows, "/x/", 1)
    assert not R.is_too_wide(groups, 3) and R.is_too_wide(groups, 2)
    assert {r["total_children"] for r in R.guarded(groups, 3).collect()} == {3}
    with pytest.raises(PySparkException, match="more than 2 groups"):
        R.guarded(groups, 2).collect()


def test_top_children_and_ties(make):
    rows = make([(f"/x/{n}/", "f", "FILE", size, 1) for n, size in zip("dcba", (5, 9, 5, 1))])
    groups = R.rollup_groups(rows, "/x/", 1)
    assert [r["name"] for r in R.children(groups).collect()] == ["c", "b", "d", "a"]
    assert [r["name"] for r in R.children(groups, 2).collect()] == ["c", "b"]
    assert R.totals(groups).first()["total_bytes"] == 20
    shares = R.with_share(R.children(groups, 3)).collect()
    assert [r["max_bytes"] for r in shares] == [9, 9, 9]
    assert shares[0]["share_percent"] == 100.0


def test_rows_scanned_without_a_second_scan(make):
    seen = Observation()
    R.rollup_groups(make(STUDIO), "/studio/", 1, seen).collect()
    assert seen.get["rows_scanned"] == 5


def test_sum_overflow_fails_loudly(make):
    rows = make([("/x/", str(i), "FILE", 2**62, 1) for i in range(3)])
    with pytest.raises(PySparkException):
        R.rollup_groups(rows, "/x/", 1).collect()
