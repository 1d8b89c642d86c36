"""Recursive totals of every directory from path intervals, in a number of steps that does not
depend on how deep the tree is.

In path order a directory's subtree is one stretch of the table: the paths from ``P`` up to
``after(P)``, the least text greater than all that start with ``P``. So

* every directory contributes two markers, at ``P`` and at ``after(P)``, to one sequence with the
  per-directory file totals; running sums over that sequence (distributed: sums inside
  range-partitioned, sorted parts, plus the totals of the parts before) give the subtree's sums
  as the difference of its two markers, and its rows of the sequence as an index range;
* newest times are a range maximum over that index range, answered from a sparse table: level
  ``k`` holds the maximum of ``2**k`` rows from each place, built from level ``k - 1`` by one
  join, and a range is covered by two overlapping blocks of one level.

Rows shuffled are one per directory and marker, and ``log2`` of the number of directories with
files levels of the table, whatever the depth; the one-row-per-ancestor explosion of
:func:`fileglade.operators.rollup.rollup_all_directories` is needed only for the names of
directories that have no row of their own, and it is deduplicated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileglade.functions.paths import child_path, explode_prefixes
from fileglade.operators.rollup import directory_totals
from fileglade.sources.storage import materialised

__all__ = ["running_totals", "subtree_totals"]

_SUMS = ("file_count", "total_bytes", "total_used")
_TIMES = ("mtime", "atime")


def _after(path: Column) -> Column:
    """The least text greater than every text that starts with ``path`` (which ends in ``/``)."""
    return F.concat(F.substring(path, F.lit(1), F.length(path) - 1), F.lit("0"))


def running_totals(frame: DataFrame, order: list[str], amounts: list[str], parts: int) -> DataFrame:
    """Adds ``before_<amount>``: the sum over all rows before each in the order of ``order``.

    Rows are range-partitioned into ``parts`` sorted parts and written once; sums are taken
    inside a part and over the totals of the parts before it, a table of one row per part.
    """
    spark = frame.sparkSession
    placed = materialised(
        frame.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), spark
    )
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__part").agg(*[F.sum(a).alias(f"__t_{a}") for a in amounts])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__part", *[F.coalesce(F.sum(f"__t_{a}").over(earlier), F.lit(0)).alias(f"__o_{a}") for a in amounts]
    )
    within = placed.select(
        "*", *[F.coalesce(F.sum(a).over(inside), F.lit(0)).alias(f"__i_{a}") for a in amounts]
    )
    return within.join(F.broadcast(offsets), "__part").select(
        *frame.columns,
        *[(F.col(f"__i_{a}") + F.col(f"__o_{a}")).cast("long").alias(f"before_{a}") for a in amounts],
    )


def _sparse_table(values: DataFrame, size: int) -> DataFrame:
    """level, at, mtime, atime: maxima of ``2**level`` rows from index ``at`` on."""
    spark = values.sparkSession
    level = materialised(values.select(F.lit(0).alias("level"), "at", *_TIMES), spark)
    levels, k = [level], 1
    while 2**k <= size:
        half = 2 ** (k - 1)
        left = level.select("at", *_TIMES)
        right = level.select((F.col("at") - half).alias("at"), *[F.col(c).alias(f"r_{c}") for c in _TIMES])
        level = materialised(
            left.join(right, "at").select(
                F.lit(k).alias("level"), "at", *[F.greatest(c, f"r_{c}").alias(c) for c in _TIMES]
            ),
            spark,
        )
        levels.append(level)
        k += 1
    table = levels[0]
    for more in levels[1:]:
        table = table.unionByName(more)
    return table


def subtree_totals(catalog: DataFrame, parts: int | None = None) -> DataFrame:
    """path, file_count, total_bytes, total_used, mtime, atime of every directory, recursively;
    the same rows as :func:`~fileglade.operators.rollup.rollup_all_directories`."""
    spark = catalog.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = materialised(directory_totals(catalog), spark)
    named = explode_prefixes(files.select("parent_path"), "parent_path", "path").select("path")
    dirs = catalog.where(F.col("element_type") == "DIR").select(
        child_path(F.col("parent_path"), F.col("name")).alias("path")
    )
    every = materialised(named.unionByName(dirs).distinct(), spark)
    data = files.select(
        F.col("parent_path").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("dir"),
        F.lit(1).cast("long").alias("rows"), *_SUMS,
    )
    marks = every.select(
        F.explode(F.array(
            F.struct(F.col("path").alias("key"), F.lit(0).alias("side")),
            F.struct(_after(F.col("path")).alias("key"), F.lit(1).alias("side")),
        )).alias("m"), "path",
    ).select(
        F.col("m.key").alias("key"), F.lit(0).alias("kind"), F.col("path").alias("dir"), F.col("m.side").alias("side"),
        *[F.lit(0).cast("long").alias(c) for c in ("rows", *_SUMS)],
    )
    sequence = data.withColumn("side", F.lit(0)).unionByName(marks)
    order = ["key", "kind", "dir", "side"]
    summed = materialised(running_totals(sequence, order, ["rows", *_SUMS], parts), spark)
    values = summed.where(F.col("kind") == 1).select(F.col("before_rows").alias("at"), F.col("key").alias("parent_path"))
    values = values.join(files.select("parent_path", *_TIMES), "parent_path").drop("parent_path")
    size = files.count()
    ends = summed.where(F.col("kind") == 0).groupBy(F.col("dir").alias("path")).agg(
        *[
            (F.max(F.when(F.col("side") == 1, F.col(f"before_{c}"))) - F.max(F.when(F.col("side") == 0, F.col(f"before_{c}")))).alias(c)
            for c in _SUMS
        ],
        F.max(F.when(F.col("side") == 0, F.col("before_rows"))).alias("low"),
        F.max(F.when(F.col("side") == 1, F.col("before_rows"))).alias("high"),
    )
    ends = ends.withColumn(
        "level", F.when(F.col("high") > F.col("low"), F.floor(F.log2(F.col("high") - F.col("low"))).cast("int"))
    )
    # log2 of a power of two may come out a little low or high: correct by the lengths themselves.
    length = F.col("high") - F.col("low")
    ends = ends.withColumn(
        "level",
        F.when(F.pow(F.lit(2), F.col("level") + 1) <= length, F.col("level") + 1)
        .when(F.pow(F.lit(2), F.col("level")) > length, F.col("level") - 1)
        .otherwise(F.col("level")),
    )
    if size == 0:
        return ends.select("path", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _SUMS],
                           *[F.lit(None).cast(catalog.schema[c].dataType).alias(c) for c in _TIMES])
    table = _sparse_table(values, size)
    first = table.select(F.col("level"), F.col("at").alias("low"), *[F.col(c).alias(f"a_{c}") for c in _TIMES])
    second = table.select(
        F.col("level"), F.col("at").alias("__second"), *[F.col(c).alias(f"b_{c}") for c in _TIMES]
    )
    start_second = (F.col("high") - F.pow(F.lit(2), F.col("level"))).cast("long")
    joined = (
        ends.join(first, ["level", "low"], "left")
        .withColumn("__second", start_second)
        .join(second, ["level", "__second"], "left")
    )
    return joined.select(
        "path",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _SUMS],
        *[F.greatest(f"a_{c}", f"b_{c}").alias(c) for c in _TIMES],
    )
