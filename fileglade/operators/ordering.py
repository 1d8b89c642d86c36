"""Order-based selections that stay whole and spread out when one group is huge."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileglade.sources.storage import materialised

#: Leading rows that a task may keep for one page.
DEEP_PAGE_ROWS = 100_000
_SMALL = 100_000
_PICKS = 10_000
_SALTS = 64
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def nth_smallest(
    rows: DataFrame, key: str, n: int, total: int, small: int = _SMALL, picks: int = _PICKS
):
    """Exact ``n``-th smallest value (from 1) of a non-null key with few repetitions.

    A few thousand sampled keys only suggest where to look: two of them enclose the place, counting
    tells how many rows lie before and between, and the search goes on in the part that holds the
    ``n``-th row. Nothing is shuffled; each pass narrows the scan with a pushed range filter, and
    what is sorted in the end is small.
    """
    if not 1 <= n <= total:
        raise ValueError("fewer rows than the requested position")
    window, column, size, seed = rows.select(key), F.col(key), total, 0
    while size > small:
        seed += 1
        share = min(1.0, picks / size)
        picked = sorted(r[0] for r in window.sample(fraction=share, seed=seed).collect())
        if not picked:
            continue
        at = len(picked) * n / size
        slack = 4 * math.sqrt(at * max(1 - n / size, 0)) + 2
        low = picked[max(int(at - slack), 0)]
        high = picked[min(int(at + slack), len(picked) - 1)]
        upto_low, upto_high = window.agg(
            F.count_if(column <= low), F.count_if(column <= high)
        ).first()
        if n <= upto_low:
            window, held = window.where(column <= low), upto_low
        elif n <= upto_high:
            window = window.where((column > low) & (column <= high))
            n, held = n - upto_low, upto_high - upto_low
        else:
            window = window.where(column > high)
            n, held = n - upto_high, size - upto_high
        if held == size:
            break
        size = held
    return window.orderBy(key).offset(n - 1).limit(1).first()[key]


def sorted_slice(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows ``offset`` to ``offset + size`` of the sorted rows.

    The rows are written once, range-sorted, with the number of their partition and their place in
    it. The sizes of the partitions, a row for each, tell in which places the slice lies.
    """
    spark = rows.sparkSession
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialised(
        rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), within.alias("_at")),
        spark,
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    tests, before = [], 0
    for part, n in sizes:
        low, high = max(offset - before, 0), min(offset + size - before, n)
        if low < high:
            inside = (F.col("_at") >= low) & (F.col("_at") < high)
            tests.append((F.col("_part") == part) & inside)
        before += n
    chosen = functools.reduce(operator.or_, tests, F.lit(False))
    return placed.where(chosen).orderBy("_part", "_at").drop("_part", "_at")


def first_per_group(
    rows: DataFrame, group: list[str], order: list[Column], n: int, salt: Column
) -> DataFrame:
    """First ``n`` rows of every group, numbered from 1 in ``position``.

    Up to its threshold Spark keeps only ``n`` rows of a group per map task (``WindowGroupLimit``),
    so a hot group reaches its reducer already cut. Beyond it a pre-pass over salted groups does
    the same: a row is dropped only if ``n`` rows of its own group and salt precede it.
    """
    threshold = int(rows.sparkSession.conf.get(_GROUP_LIMIT, "1000"))
    if n > threshold:
        by_salt = Window.partitionBy(*group, "_salt").orderBy(*order)
        rows = (
            rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(_SALTS)))
            .withColumn("_n", F.row_number().over(by_salt))
            .where(F.col("_n") <= n)
            .drop("_n", "_salt")
        )
    by_group = Window.partitionBy(*group).orderBy(*order)
    return (
        rows.withColumn("position", F.row_number().over(by_group))
        .where(F.col("position") <= n)
        .withColumn("position", F.col("position").cast("bigint"))
    )
