"""Subtree rollup: FILE rows below a prefix, grouped by leading path components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fileglade.functions.paths import (
    child_path,
    explode_prefixes,
    group_key,
    leading_components,
    normalize_prefix,
)
from fileglade.functions.text import human_size, iso_time
from fileglade.schema import ROLLUP_MAX_DEPTH, ROLLUP_MAX_GROUPS
from fileglade.sources.catalog import (
    PUSHED_PREFIXES,
    child_directories,
    subtree_files,
    under_any,
)
from fileglade.sources.storage import materialised


class RollupTooWide(RuntimeError):
    """The grouping has more groups than allowed."""


def too_wide_message(max_groups: int) -> str:
    return f"more than {max_groups} groups: reduce the depth or choose a smaller subtree"


def check_request(
    path: str, depth: int, allow_root: bool = False, max_depth: int = ROLLUP_MAX_DEPTH
) -> str:
    """Validate a rollup request; returns the normalised prefix."""
    prefix = normalize_prefix(path)
    if not 1 <= depth <= max_depth:
        raise ValueError(f"depth {depth} is outside 1..{max_depth}")
    if prefix == "/" and not allow_root:
        raise PermissionError("a rollup of the entire namespace needs allow_root=True")
    return prefix


_MEASURES = ["file_count", "total_bytes", "total_used", "mtime", "atime"]


def _measured(files: DataFrame, *keys: str | Column) -> DataFrame:
    """File rows as groups of one, ready to merge. A file of unknown size is still a file."""
    return files.select(
        *keys,
        F.lit(1).cast("bigint").alias("file_count"),
        F.col("size").alias("total_bytes"),
        F.col("used").alias("total_used"),
        "mtime",
        "atime",
    )


def merge_groups(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Group states merged by ``keys``: sums of counts and bytes, latest times.

    Parts that lack a state (seeds) add nothing. Partial results combine before the shuffle.
    """
    return parts.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _MEASURES[:3]],
        *[F.max(c).alias(c) for c in _MEASURES[3:]],
    )


def rollup_groups(
    catalog: DataFrame, prefix: str, depth: int = 1, observation: Observation | None = None
) -> DataFrame:
    """Per-group totals with one shuffle.

    The big scan covers files only and never reads their names. The child directories that seed
    empty groups come from a second scan, by equality on the directory, which a path-sorted table
    answers from a few pages; they join the same aggregation as groups of nothing. Partial
    aggregation leaves one row per task and group, so a prefix with most of the files is no hot
    spot. At any depth the seeds are immediate child names.
    """
    files = subtree_files(catalog, prefix)
    if observation is not None:
        files = files.observe(observation, F.count(F.lit(1)).alias("rows_scanned"))
    parent = F.col("parent_path")
    leading = files.withColumn("_leading", leading_components(parent, prefix, depth))
    key = group_key(parent, prefix, depth, F.col("_leading")).alias("name")
    seeds = child_directories(catalog, prefix)
    parts = _measured(leading, key).unionByName(seeds, allowMissingColumns=True)
    return merge_groups(parts, ["name"])


def directory_totals(catalog: DataFrame) -> DataFrame:
    """Totals of the files directly in each directory: the first step of many rollups at once."""
    files = catalog.where(F.col("element_type") == "FILE")
    return merge_groups(_measured(files, "parent_path"), ["parent_path"])


def rollup_many(catalog: DataFrame, requests: list[tuple[str, int]]) -> DataFrame:
    """Any number of rollups (prefix, depth) together, told apart by both columns.

    Files are first folded into one row per directory; only those rows meet the requests, by
    equality on their own leading paths. A request list of checked length is broadcast.
    """
    spark = catalog.sparkSession
    wanted = sorted({(normalize_prefix(p), d) for p, d in requests})
    targets = spark.createDataFrame(wanted, "prefix string, depth int")
    if len(wanted) <= ROLLUP_MAX_GROUPS:
        targets = F.broadcast(targets)
    prefixes = sorted({p for p, _ in wanted})
    below = catalog.where(under_any(prefixes))
    files = (
        explode_prefixes(directory_totals(below), "parent_path", "prefix")
        .join(targets, "prefix")
        .withColumn("name", group_key(F.col("parent_path"), F.col("prefix"), F.col("depth")))
        .drop("parent_path")
    )
    parents = below.where(F.col("element_type") == "DIR")
    if len(prefixes) <= PUSHED_PREFIXES:
        parents = parents.where(F.col("parent_path").isin(prefixes))
    seeds = (
        parents.select(F.col("parent_path").alias("prefix"), "name")
        .join(targets, "prefix")
    )
    parts = files.unionByName(seeds, allowMissingColumns=True)
    return merge_groups(parts, ["prefix", "depth", "name"])


def rollup_all_directories(catalog: DataFrame) -> DataFrame:
    """Recursive totals of every directory in one pass, empty directories included."""
    files = explode_prefixes(directory_totals(catalog), "parent_path", "path").drop("parent_path")
    seeds = catalog.where(F.col("element_type") == "DIR").select(
        child_path(F.col("parent_path"), F.col("name")).alias("path")
    )
    return merge_groups(files.unionByName(seeds, allowMissingColumns=True), ["path"])


def guarded(groups: DataFrame, max_groups: int = ROLLUP_MAX_GROUPS) -> DataFrame:
    """Groups with ``total_children``; the job fails if there are more than ``max_groups``.

    The limit comes first, so the one-partition count sees at most ``max_groups + 1`` rows.
    """
    everything = Window.partitionBy()
    counted = groups.limit(max_groups + 1).withColumn(
        "total_children", F.count(F.lit(1)).over(everything)
    )
    fits = F.col("total_children") <= max_groups
    return counted.where(
        F.when(fits, F.lit(True)).otherwise(
            F.raise_error(too_wide_message(max_groups)).cast("boolean")
        )
    )


def is_too_wide(groups: DataFrame, max_groups: int = ROLLUP_MAX_GROUPS) -> bool:
    return groups.limit(max_groups + 1).count() > max_groups


def children(groups: DataFrame, child_limit: int | None = None) -> DataFrame:
    """Groups by bytes, largest first, ISO times; the name breaks ties. All, or ``child_limit``."""
    return ranked(groups) if child_limit is None else ranked(groups).limit(child_limit)


def ranked(groups: DataFrame) -> DataFrame:
    """All groups by bytes, largest first, with ISO times."""
    kept = [c for c in groups.columns if c not in ("mtime", "atime")]
    return groups.orderBy(F.desc("total_bytes"), F.asc("name")).select(
        *kept,
        iso_time(groups, "mtime").alias("last_modified"),
        iso_time(groups, "atime").alias("last_accessed"),
    )


def totals(groups: DataFrame) -> DataFrame:
    """One row over all groups. There is a last modification but, by design, no last access."""
    folded = groups.agg(
        F.coalesce(F.sum("file_count"), F.lit(0)).alias("file_count"),
        F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("total_used"), F.lit(0)).alias("total_used"),
        F.max("mtime").alias("mtime"),
    )
    return folded.select(
        "file_count", "total_bytes", "total_used", iso_time(folded, "mtime").alias("last_modified")
    )


def with_rank(groups: DataFrame) -> DataFrame:
    """Groups by bytes with their ``rank``, from 1.

    Sorted by ranges and written; a partition's rows follow those of all partitions before it,
    whose sizes are the only thing that is gathered.
    """
    spark = groups.sparkSession
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ordered = groups.orderBy(F.desc("total_bytes"), F.asc("name"))
    placed = materialised(
        ordered.select("*", F.spark_partition_id().alias("_part"), within.alias("_at")), spark
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    rank = (F.col("_before") + F.col("_at") + 1).cast("bigint")
    return placed.join(F.broadcast(before), "_part").withColumn("rank", rank).drop("_part", "_at", "_before")


def with_share(top: DataFrame) -> DataFrame:
    """Bytes relative to the largest group given, and as text."""
    largest = top.agg(F.greatest(F.lit(1), F.max("total_bytes")).alias("max_bytes"))
    return top.withColumn("max_bytes", largest.scalar()).select(
        *top.columns,
        "max_bytes",
        (F.lit(100) * F.col("total_bytes") / F.col("max_bytes")).alias("share_percent"),
        human_size(F.col("total_bytes")).alias("size_text"),
    )
