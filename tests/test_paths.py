import random

import pytest
from pyspark.sql import functions as F

from fileglade.functions import paths as P

NORMAL = {
    "": "/",
    "/": "/",
    "////": "/",
    "harbor": "/harbor/",
    "/harbor": "/harbor/",
    "/harbor/": "/harbor/",
    "///q/r///": "/q/r/",
    "/q///r": "/q///r/",
    "/two words /z": "/two words /z/",
}


def test_normalize_prefix(spark):
    assert {p: P.normalize_prefix(p) for p in NORMAL} == NORMAL
    frame = spark.createDataFrame([(p,) for p in NORMAL], "p string")
    rows = frame.select("p", P.normalized(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == NORMAL


def test_prefix_does_not_reach_siblings(spark):
    frame = spark.createDataFrame([("/dock/k/",), ("/dock/",), ("/docker/",), ("/dock9/m/",)], "p string")
    kept = frame.where(F.col("p").startswith(P.normalize_prefix("dock")))
    assert [r["p"] for r in kept.collect()] == ["/dock/k/", "/dock/"]


@pytest.mark.parametrize(
    "parent, prefix, depth, key",
    [
        ("/harbor/crane/k/", "/harbor/", 1, "crane"),
        ("/harbor/crane/", "/harbor/", 1, "crane"),
        ("/harbor/", "/harbor/", 1, "."),
        ("/harbor/crane/k/m/", "/harbor/", 2, "crane/k"),
        ("/harbor/crane/", "/harbor/", 2, "crane"),
        ("/q//r/s/", "/q/", 1, "r"),
        ("/q/r//s/", "/q/", 8, "r/s"),
        ("/q//", "/q/", 3, "."),
        ("/", "/", 1, "."),
        ("/ü/😀/50%_x/", "/ü/", 1, "😀"),
        ("/ü/😀/50%_x/", "/ü/😀/", 1, "50%_x"),
    ],
)
def test_group_key(spark, parent, prefix, depth, key):
    frame = spark.createDataFrame([(parent, prefix, depth)], "p string, x string, d int")
    fixed = P.group_key(F.col("p"), prefix, depth)
    by_column = P.group_key(F.col("p"), F.col("x"), F.col("d"))
    assert tuple(frame.select(fixed, by_column).first()) == (key, key)


def test_group_key_of_random_trees(spark):
    rng = random.Random(7)
    names = ["a", "b", "c c", "😀", "%", "_", "", "é", "long-name"]
    paths = ["/" + "".join(rng.choice(names) + "/" for _ in range(rng.randint(0, 9))) for _ in range(400)]
    cases = []
    for path in paths:
        cuts = [i + 1 for i, c in enumerate(path) if c == "/"]
        cases.append((path, path[: rng.choice(cuts)], rng.randint(1, 8)))
    frame = spark.createDataFrame(cases, "p string, x string, d int")
    rows = frame.withColumn("key", P.group_key(F.col("p"), F.col("x"), F.col("d"))).collect()
    for row in rows:
        parts = [c for c in row["p"].removeprefix(row["x"]).split("/") if c]
        assert row["key"] == ("/".join(parts[: row["d"]]) or "."), row


def test_ancestors(spark):
    frame = spark.createDataFrame([("/a/b/c/",), ("/",)], "p string")
    rows = frame.select(P.ancestors(F.col("p")).alias("crumbs")).collect()
    assert [tuple(c) for c in rows[0]["crumbs"]] == [
        (0, "/", "/"),
        (1, "a", "/a/"),
        (2, "b", "/a/b/"),
        (3, "c", "/a/b/c/"),
    ]
    assert [tuple(c) for c in rows[1]["crumbs"]] == [(0, "/", "/")]


def test_path_prefixes_keep_empty_components(spark):
    frame = spark.createDataFrame([("/a//b/",), ("/",)], "p string")
    rows = frame.select(P.path_prefixes(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in rows] == [["/", "/a/", "/a//", "/a//b/"], ["/"]]
    each = P.explode_prefixes(frame, "p", "x").collect()
    assert [r["x"] for r in each] == ["/", "/a/", "/a//", "/a//b/", "/"]


def test_slug_and_component_count(spark):
    assert [P.slug(p) for p in ("/", "", "/a/b/", "a")] == ["root", "root", "a_b", "a"]
    frame = spark.createDataFrame([("/",), ("/a/",), ("/a/b/",)], "p string")
    assert [r[0] for r in frame.select(P.component_count(F.col("p"))).collect()] == [0, 1, 2]
