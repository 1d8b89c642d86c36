"""Prefix ranges: disjoint scan ranges, innermost roots by search, frontier of many roots."""

import random

from fileglade.operators import hierarchy
from fileglade.sources.catalog import innermost_intervals, innermost_prefix, prefix_ranges

ROOTS = ["/k/", "/k/q/", "/k/q/z/", "/k/r/", "/m/", "/ma/", "/k/q0/"]


def innermost(path, roots):
    holding = [r for r in roots if path.startswith(r)]
    return max(holding, key=len) if holding else None


def test_ranges_drop_nested_roots():
    assert prefix_ranges(ROOTS) == [("/k/", "/k0"), ("/m/", "/m0"), ("/ma/", "/ma0")]


def test_search_equals_brute_force(spark):
    rng = random.Random(7)
    parts = ["k", "q", "z", "r", "m", "ma", "q0", "zz", "é"]
    paths = ["/" + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) + "/" for _ in range(400)]
    paths += ["/k", "/k0", "", "/", "/ka/", None]
    for roots in (ROOTS, ROOTS[:1], [], [f"/k/{i}/" for i in range(50)] + ["/k/"]):
        frame = spark.createDataFrame([(p,) for p in paths], "p string")
        found = innermost_prefix(frame["p"], innermost_intervals(roots))
        got = [r[1] for r in frame.select("p", found).collect()]
        assert got == [innermost(p, roots) if p is not None else None for p in paths]


def test_frontier_ranges_equals_frontier(stored):
    roots = ["/documents/", "/lineitem/A/", "/lineitem/A/1995/", "/lineitem/R/1993/", "/nowhere/"]
    for depth in (1, 2, 3):
        got = sorted(map(tuple, hierarchy.frontier_ranges(stored, roots, depth).collect()))
        want = sorted(map(tuple, hierarchy.frontier(stored, roots, depth, few=0).collect()))
        assert got == want


def test_scan_reads_ranges_not_their_common_beginning(stored):
    roots = [f"/documents/src{i}/" for i in range(40)] + ["/lineitem/N/"]
    plan = hierarchy.frontier_ranges(stored, roots, 1)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]", 1)[0]
    assert "/lineitem/N/" in pushed and "/documents/src9/" in pushed
