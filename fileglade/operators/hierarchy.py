"""The directory tree: frontier walk, children to fetch ahead, tree levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileglade.functions.paths import (
    ancestors,
    child_path,
    component_count,
    normalize_prefix,
    path_prefixes,
)
from fileglade.operators.ordering import first_per_group
from fileglade.schema import (
    FRONTIER_DEPTH,
    PREFETCH_CHILDREN,
    ROLLUP_MAX_GROUPS,
    TREE_CHILDREN,
)
from fileglade.sources.catalog import (
    PUSHED_PREFIXES,
    in_ranges,
    innermost_intervals,
    innermost_prefix,
    prefix_ranges,
    under_any,
)


def directories(catalog: DataFrame) -> DataFrame:
    """DIR rows with the path they stand for."""
    return catalog.where(F.col("element_type") == "DIR").select(
        "parent_path", "name", child_path(F.col("parent_path"), F.col("name")).alias("path")
    )


def _by_nearest_root(parent_path: Column, values: dict[str, str | int]) -> Column:
    """Value of the longest root that contains a directory."""
    chosen = F.lit(None)
    for root in sorted(values, key=len):
        chosen = F.when(parent_path.startswith(root), F.lit(values[root])).otherwise(chosen)
    return chosen


def _below_few(catalog: DataFrame, starts: list[str], depth: int) -> DataFrame:
    """Directories below some roots, by pushed prefix filters and no join."""
    parent = F.col("parent_path")
    above = _by_nearest_root(parent, {r: r.count("/") - 1 for r in starts})
    level = (component_count(parent) + 1 - above).cast("bigint")
    return (
        directories(catalog.where(under_any(starts)).where(level <= depth))
        .where(~F.col("path").isin(starts))
        .select(
            "path",
            _by_nearest_root(parent, {r: r for r in starts}).alias("root"),
            level.alias("level"),
        )
    )


def _below_many(catalog: DataFrame, starts: list[str], depth: int) -> DataFrame:
    """The same for many roots: a root in reach is one of the last ``depth`` leading paths, so
    those meet the roots by equality. Of two prefixes of a path the longer is the greater text."""
    spark = catalog.sparkSession
    roots = spark.createDataFrame([(r,) for r in starts], "root string")
    if len(starts) <= ROLLUP_MAX_GROUPS:
        roots = F.broadcast(roots)
    prefixes = path_prefixes(F.col("parent_path"))
    first = F.greatest(F.size(prefixes) - depth + 1, F.lit(1))
    found = (
        directories(catalog.where(under_any(starts)))
        .select("path", F.explode(F.slice(prefixes, first, F.lit(depth))).alias("root"))
        .join(roots, "root")
        .groupBy("path")
        .agg(F.max("root").alias("root"))
    )
    level = component_count(F.col("path")) - component_count(F.col("root"))
    themselves = roots.withColumnRenamed("root", "path")
    return found.withColumn("level", level.cast("bigint")).join(themselves, "path", "left_anti")


def frontier(
    catalog: DataFrame,
    roots: list[str],
    depth: int = FRONTIER_DEPTH,
    few: int = PUSHED_PREFIXES,
) -> DataFrame:
    """Every directory a breadth-first walk reaches from the roots in ``depth`` levels.

    A path carries its own level, so the walk is a filter and not an iteration: the level below
    the nearest root is the smallest over all roots, and each directory has one row (any chain
    from a farther root runs through the nearest). Roots are level 0 whether or not the catalog
    knows them. A directory below a missing DIR row is not reached; such gaps come
    from one pre-aggregated pass and leave by an anti-join.
    """
    starts = list(dict.fromkeys(normalize_prefix(r) for r in roots))
    start_rows = catalog.sparkSession.createDataFrame(
        [(p, 0) for p in starts], "path string, level bigint"
    )
    if depth < 1 or not starts:
        return start_rows
    below = (_below_few if len(starts) <= few else _below_many)(catalog, starts, depth)
    if depth > 1:
        below = _connected(below)
    return start_rows.unionByName(below.select("path", "level"))


def frontier_ranges(catalog: DataFrame, roots: list[str], depth: int = FRONTIER_DEPTH) -> DataFrame:
    """:func:`frontier` for any number of roots, read by key ranges.

    Roots inside other roots are dropped from the scan; the rest become sorted, disjoint key
    ranges of ``parent_path``, which reach the Parquet reader as they are, so two far branches
    never read what lies between them. Each directory finds its nearest root by a binary search
    in the intervals that nested roots cut the ranges into: no join, no shuffle, and the work for
    a row grows with the logarithm of the number of roots.
    """
    starts = list(dict.fromkeys(normalize_prefix(r) for r in roots))
    start_rows = catalog.sparkSession.createDataFrame([(p, 0) for p in starts], "path string, level bigint")
    if depth < 1 or not starts:
        return start_rows
    scanned = catalog.where(in_ranges("parent_path", prefix_ranges(starts)))
    nearest = innermost_prefix(F.col("parent_path"), innermost_intervals(starts))
    found = directories(scanned).withColumn("root", nearest).where(F.col("root").isNotNull())
    level = component_count(F.col("path")) - component_count(F.col("root"))
    below = found.withColumn("level", level.cast("bigint")).where(F.col("level") <= depth)
    below = below.where(~F.col("path").isin(starts)) if len(starts) <= ROLLUP_MAX_GROUPS else below.join(
        start_rows.select("path"), "path", "left_anti"
    )
    if depth > 1:
        below = _connected(below)
    return start_rows.unionByName(below.select("path", "level"))


def _connected(below: DataFrame) -> DataFrame:
    """Directories whose chain up to their root has no missing row."""
    path, root = F.col("path"), F.col("root")
    chain = F.filter(
        path_prefixes(path), lambda p: F.startswith(p, root) & (p != root)
    )
    steps = below.select("path", F.explode(chain).alias("step"))
    gaps = (
        steps.groupBy("step")
        .agg(F.bool_or(F.col("step") == path).alias("known"))
        .where(~F.col("known"))
        .select("step")
    )
    return below.join(steps.join(gaps, "step").select("path"), "path", "left_anti")


def capped_frontier(reached: DataFrame, max_dirs: int | None = None) -> DataFrame:
    """The first ``max_dirs`` directories in level order; all of them without a number."""
    ordered = reached if max_dirs is None else reached.orderBy("level", "path").limit(max_dirs)
    return ordered


def left_out(reached: DataFrame, max_dirs: int | None) -> int:
    """How many directories a capped frontier leaves out."""
    return 0 if max_dirs is None else max(reached.count() - max_dirs, 0)


def not_yet_materialised(wanted: DataFrame, ready: DataFrame) -> DataFrame:
    """Directories of ``wanted`` without an entry for their snapshot in ``ready``."""
    return wanted.join(ready, ["snapshot", "path"], "left_anti")


def first_children(catalog: DataFrame, n: int = PREFETCH_CHILDREN) -> DataFrame:
    """First ``n`` child directories by name of every directory: what to fetch ahead."""
    return first_per_group(
        directories(catalog), ["parent_path"], [F.col("name")], n, salt=F.col("name")
    )


def tree_levels(catalog: DataFrame, n: int = TREE_CHILDREN) -> DataFrame:
    """First ``n`` child directories of every directory and how many more there are.

    The count is its own pre-aggregated group-by: a count over the window would gather every
    child of a huge directory in one task.
    """
    rows = directories(catalog)
    counts = rows.groupBy("parent_path").agg(F.count(F.lit(1)).alias("total_dirs"))
    shown = first_per_group(rows, ["parent_path"], [F.col("name")], n, salt=F.col("name"))
    more = F.greatest(F.col("total_dirs") - n, F.lit(0))
    return shown.join(counts, "parent_path").withColumn("more_dirs", more)


def tree_level(catalog: DataFrame, path: str, n: int = TREE_CHILDREN) -> DataFrame:
    """The tree level of one directory."""
    return tree_levels(catalog.where(F.col("parent_path") == normalize_prefix(path)), n)


def breadcrumbs(paths: DataFrame, column: str = "path") -> DataFrame:
    """One row per ancestor of each path, root first."""
    crumbs = paths.select(
        F.col(column).alias("of_path"), F.explode(ancestors(F.col(column))).alias("crumb")
    )
    return crumbs.select("of_path", "crumb.*")


def expand_to(paths: DataFrame, root: str, column: str = "path") -> DataFrame:
    """Tree nodes to open, top down, to bring each path below ``root`` into view."""
    top = normalize_prefix(root)
    crumbs = breadcrumbs(paths.where(F.col(column).startswith(top)), column)
    return crumbs.where(F.col("path").startswith(top))
