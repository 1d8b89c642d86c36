"""Rollups of a new snapshot from the last result and what changed in between.

A snapshot differs from the one before in a few directories. Each refresh keeps, beside its
rollup groups, a *directory state*: one row per directory with files below the requested
prefixes, holding the file count, byte sums, newest times and an XOR of row hashes. The next
refresh

1. folds the new snapshot into the same state (one pre-aggregated scan, a shuffle of one row per
   task and directory, never of files);
2. merges the two states by a full outer join on the directory and keeps the directories whose
   state differs: added, removed or changed;
3. spreads only those directories over their groups and adds the differences of counts and
   sums to the old groups; groups without a changed directory are read from the last result as
   they are;
4. takes the newest times as the later of the old group's and the changed directories' new ones,
   except where a changed directory held the old maximum and lost it: only those groups are
   recomputed, from the new state of their directories;
5. seeds empty groups from the new snapshot's child directories, as a full rollup does, and drops
   groups left with neither files nor a seed.

The result equals a full :func:`rollup_many` of the new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileglade.functions.paths import explode_prefixes, group_key, normalize_prefix
from fileglade.schema import ROLLUP_MAX_GROUPS
from fileglade.sources.catalog import PUSHED_PREFIXES, under_any
from fileglade.sources.storage import materialised

__all__ = ["changed_directories", "directory_state", "refreshed_groups"]

_SUMS = ("file_count", "total_bytes", "total_used")
_TIMES = ("mtime", "atime")
_STATE = (*_SUMS, *_TIMES, "digest")


def directory_state(catalog: DataFrame, requests: list[tuple[str, int]]) -> DataFrame:
    """parent_path, file_count, total_bytes, total_used, mtime, atime, digest for each directory
    with files below the requested prefixes."""
    prefixes = sorted({normalize_prefix(p) for p, _ in requests})
    files = catalog.where(under_any(prefixes) & (F.col("element_type") == "FILE"))
    row = F.xxhash64("name", "size", "used", "mtime", "atime")
    return files.groupBy("parent_path").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("total_used"),
        F.max("mtime").alias("mtime"),
        F.max("atime").alias("atime"),
        F.bit_xor(row).alias("digest"),
    )


def changed_directories(old: DataFrame, new: DataFrame) -> DataFrame:
    """parent_path with old_* and new_* states of every directory that was added, removed or
    changed; a missing side is null."""
    left = old.select("parent_path", *[F.col(c).alias(f"old_{c}") for c in _STATE])
    right = new.select("parent_path", *[F.col(c).alias(f"new_{c}") for c in _STATE])
    same = [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in _STATE]
    merged = left.join(right, "parent_path", "full_outer")
    return merged.where(~_all(same))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _targets(spark, requests: list[tuple[str, int]]) -> tuple[DataFrame, list[str]]:
    wanted = sorted({(normalize_prefix(p), d) for p, d in requests})
    targets = spark.createDataFrame(wanted, "prefix string, depth int")
    if len(wanted) <= ROLLUP_MAX_GROUPS:
        targets = F.broadcast(targets)
    return targets, sorted({p for p, _ in wanted})


def _grouped(directories: DataFrame, targets: DataFrame) -> DataFrame:
    """Directory rows spread over the (prefix, depth, name) groups that hold them."""
    return (
        explode_prefixes(directories, "parent_path", "prefix")
        .join(targets, "prefix")
        .withColumn("name", group_key(F.col("parent_path"), F.col("prefix"), F.col("depth")))
    )


def refreshed_groups(
    new_catalog: DataFrame,
    requests: list[tuple[str, int]],
    old_groups: DataFrame,
    old_state: DataFrame,
    new_state: DataFrame | None = None,
) -> DataFrame:
    """prefix, depth, name, file_count, total_bytes, total_used, mtime, atime of the new snapshot.

    ``old_groups`` and ``old_state`` are the groups and directory state of the last snapshot for
    the same requests; ``new_state`` is :func:`directory_state` of the new one, if already made.
    """
    spark = new_catalog.sparkSession
    targets, prefixes = _targets(spark, requests)
    if new_state is None:
        new_state = directory_state(new_catalog, requests)
    changed = changed_directories(old_state, new_state)

    def gone(c: str) -> Column:
        """The old newest time of a directory that no longer has it."""
        old, new = F.col(f"old_{c}"), F.col(f"new_{c}")
        return F.when(old.isNotNull() & (new.isNull() | (new < old)), old)

    deltas = _grouped(changed, targets).groupBy("prefix", "depth", "name").agg(
        *[
            F.sum(F.coalesce(F.col(f"new_{c}"), F.lit(0)) - F.coalesce(F.col(f"old_{c}"), F.lit(0))).alias(f"d_{c}")
            for c in _SUMS
        ],
        *[F.max(f"new_{c}").alias(f"up_{c}") for c in _TIMES],
        *[F.max(gone(c)).alias(f"gone_{c}") for c in _TIMES],
    )
    keys = ["prefix", "depth", "name"]
    merged = old_groups.select(*keys, *_SUMS, *_TIMES).join(deltas, keys, "full_outer")
    lost = [
        F.col(f"gone_{c}").isNotNull() & (F.col(c).isNull() | (F.col(f"gone_{c}") >= F.col(c))) for c in _TIMES
    ]
    updated = merged.select(
        *keys,
        *[(F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"d_{c}"), F.lit(0))).alias(c) for c in _SUMS],
        *[
            F.when(~test, F.greatest(F.col(c), F.col(f"up_{c}"))).alias(c)
            for c, test in zip(_TIMES, lost)
        ],
        (lost[0] | lost[1]).alias("_again"),
    )
    updated = materialised(updated, spark)  # counted below and read again: computed once
    again = updated.where("_again").select(*keys)
    if again.limit(1).count():
        # Only groups whose newest file went: their times from the new state of their directories.
        small = again.limit(ROLLUP_MAX_GROUPS + 1).count() <= ROLLUP_MAX_GROUPS
        redo = F.broadcast(again) if small else again
        times = (
            _grouped(new_state.select("parent_path", *_TIMES), targets)
            .join(redo, keys, "left_semi")
            .groupBy(*keys)
            .agg(*[F.max(c).alias(f"re_{c}") for c in _TIMES])
        )
        updated = updated.join(times, keys, "left").select(
            *keys, *_SUMS,
            *[F.when(F.col("_again"), F.col(f"re_{c}")).otherwise(F.col(c)).alias(c) for c in _TIMES],
        )
    else:
        updated = updated.drop("_again")
    parents = new_catalog.where(under_any(prefixes) & (F.col("element_type") == "DIR"))
    if len(prefixes) <= PUSHED_PREFIXES:
        parents = parents.where(F.col("parent_path").isin(prefixes))
    seeds = (
        parents.select(F.col("parent_path").alias("prefix"), "name").join(targets, "prefix")
        .select(*keys, F.lit(True).alias("_seed")).distinct()
    )
    whole = updated.join(seeds, keys, "full_outer")
    return whole.where((F.coalesce(F.col("file_count"), F.lit(0)) > 0) | F.col("_seed").isNotNull()).select(
        *keys,
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in _SUMS],
        *_TIMES,
    )
