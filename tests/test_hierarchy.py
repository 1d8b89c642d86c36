import pytest
from pyspark.sql import functions as F

from fileglade.operators import annotate as A
from fileglade.operators import hierarchy as H
from fileglade.operators import rollup as R


def farm_tree():
    rows = [("/", "farm", "DIR"), ("/", "lodge", "DIR")]
    for i in range(14):
        rows.append(("/farm/", f"field-{i:02d}", "DIR"))
        rows += [(f"/farm/field-{i:02d}/", sub, "DIR") for sub in ("barn", "crop", "soil")]
        rows.append((f"/farm/field-{i:02d}/crop/", "yield", "FILE", i, i))
    return rows


def walk(rows, roots, depth):
    """Breadth-first walk, level by level."""
    children = {}
    for parent, name, kind, *_ in rows:
        if kind == "DIR":
            children.setdefault(parent, []).append(f"{parent}{name}/")
    seen, level = {}, list(dict.fromkeys(roots))
    for depth_now in range(depth + 1):
        level = [p for p in dict.fromkeys(level) if p not in seen]
        seen.update(dict.fromkeys(level, depth_now))
        level = [c for p in level for c in children.get(p, [])]
    return seen


def levels(frame):
    rows = [tuple(r) for r in frame.select("path", "level").collect()]
    assert len(rows) == len(set(rows))
    return dict(rows)


@pytest.mark.parametrize("depth", [0, 1, 2, 3])
@pytest.mark.parametrize(
    "roots", [["/farm/"], ["/"], ["/farm/field-01/", "/farm/", "/farm/"], ["/nix/", "/lodge/"]]
)
@pytest.mark.parametrize("few", [32, 0])
def test_frontier_equals_a_walk(make, roots, depth, few):
    rows = farm_tree()
    assert levels(H.frontier(make(rows), roots, depth, few)) == walk(rows, roots, depth)


def test_frontier_of_many_roots(make):
    rows = farm_tree()
    roots = [f"/farm/field-{i:02d}/" for i in range(14)] + [f"/nix/{i}/" for i in range(40)]
    roots += ["/farm/", "/farm/field-03/crop/"]
    for depth in (0, 1, 2):
        assert levels(H.frontier(make(rows), roots, depth)) == walk(rows, roots, depth)


def test_frontier_sizes(make):
    tree = make(farm_tree())
    assert H.frontier(tree, ["/farm"], 1).count() == 15
    assert H.frontier(tree, ["/farm", "/lodge"], 0).count() == 2
    capped = H.capped_frontier(H.frontier(tree, ["/farm"], 3), 4)
    assert [tuple(r) for r in capped.collect()][0] == ("/farm/", 0) and capped.count() == 4


def test_frontier_stops_at_a_missing_directory(make):
    rows = farm_tree() + [
        ("/farm/lost/", "deep", "DIR"),
        ("/farm/lost/deep/", "deeper", "DIR"),
        ("/farm/field-03/crop/", "kept", "DIR"),
    ]
    for roots in (["/farm/"], ["/farm/", "/farm/lost/"], ["/farm/", "/farm/lost/deep/"]):
        for depth, few in ((1, 32), (2, 32), (3, 32), (3, 0)):
            got = levels(H.frontier(make(rows), roots, depth, few))
            assert got == walk(rows, roots, depth)


def test_missing_directories(spark, make):
    tree = make(farm_tree())
    snapshot = F.lit("s1").alias("snapshot")
    wanted = H.frontier(tree, ["/farm/"], 1).select(snapshot, "path")
    ready = H.frontier(tree, ["/farm/"], 0).select(snapshot, "path")
    assert H.not_yet_materialised(wanted, ready).count() == 14
    other = ready.withColumn("snapshot", F.lit("s0"))
    assert H.not_yet_materialised(wanted, other).count() == 15


def test_first_children_and_tree_level(make):
    tree = make(farm_tree())
    firsts = H.first_children(tree, 8).where("parent_path = '/farm/'").orderBy("position")
    assert [r["name"] for r in firsts.collect()] == [f"field-{i:02d}" for i in range(8)]
    level = H.tree_level(tree, "/farm", 10).collect()
    assert len(level) == 10 and {(r["total_dirs"], r["more_dirs"]) for r in level} == {(14, 4)}
    assert {r["more_dirs"] for r in H.tree_level(tree, "/", 10).collect()} == {0}


def test_expand_to(spark):
    paths = spark.createDataFrame([("/a/b/c/",), ("/x/",)], "path string")
    rows = H.expand_to(paths, "/a").orderBy("position").collect()
    assert [r["path"] for r in rows] == ["/a/", "/a/b/", "/a/b/c/"]


ANNOTATED = [
    ("/d/", "big", "DIR"),
    ("/d/", "small", "DIR"),
    ("/d/", "same", "FILE", 5, 5),
    ("/d/big/", "f", "FILE", 2048, 1),
    ("/d/small/", "f", "FILE", 10, 1),
    ("/d/same/", "f", "FILE", 11, 1),
]


def test_annotated_listing_states(make):
    catalog = make(ANNOTATED)
    page = catalog.where("parent_path = '/d/'").select("name", "element_type")
    groups = R.rollup_groups(catalog, "/d/", 1)

    def states(children, **kw):
        rows = A.annotated_listing(page, children, **kw).collect()
        return {r["name"]: (r["rollup_bytes"], r["rollup_state"]) for r in rows}

    assert states(R.children(groups)) == {
        "big": (2048, "stats"),
        "small": (10, "stats"),
        "same": (None, None),
    }
    cut = states(R.children(groups, 1), children_truncated=True)
    assert cut["small"] == (None, "truncated")
    old = R.children(groups.where("name <> 'small'"))
    assert states(old)["small"] == (None, "newer")
    assert states(None)["small"] == (None, "none")


def test_annotated_tree(spark, make):
    children = R.children(R.rollup_groups(make(ANNOTATED), "/d/", 1), 1)
    nodes = spark.createDataFrame(
        [("/",), ("/d/",), ("/d/big/",), ("/d/small/",), ("/d/big/x/",), ("/dd/",)], "path string"
    )
    badges = {r["path"]: r["badge"] for r in A.annotated_tree(nodes, children, "/d/").collect()}
    assert badges == {
        "/": None,
        "/d/": None,
        "/d/big/": "2.0 KiB",
        "/d/small/": "",
        "/d/big/x/": None,
        "/dd/": None,
    }
