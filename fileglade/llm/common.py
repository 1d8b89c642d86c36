"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fileglade.sources.storage import materialised

__all__ = ["let", "materialised", "prefix_sums", "salted_join", "slices", "sized", "table", "worker_path"]

#: Rows of a table that may be broadcast; more are joined by a salted shuffle.
BROADCAST_ROWS = 100_000


def worker_path(spark: SparkSession) -> None:
    """Lets Python workers on this machine import the package from where the driver did.

    Other machines need it installed or sent with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, tables: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{tables.rstrip('/')}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def sized(texts: DataFrame, column: str, mb: int) -> int:
    """Partitions that hold about ``mb`` MB of the column each."""
    total = texts.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, -(-total // (mb * 1_000_000)))


def salted_join(
    many: DataFrame, few: DataFrame, on: list[str], salt: Column, salts: int = 32
) -> DataFrame:
    """``many`` left-joined with a written table ``few`` that has one row for each key.

    Keys are compared null-safe. ``few`` is broadcast only after its rows were counted; a larger
    one meets the salted rows, so that a key with a third of ``many`` goes to ``salts`` tasks.
    """
    right = few.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in few.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    drop = [f"__{c}" for c in on]
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(right), same, "left").drop(*drop)
    right = right.withColumn("__right_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = many.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int"))
    same.append(F.col("__salt") == F.col("__right_salt"))
    return left.join(right, same, "left").drop(*drop, "__salt", "__right_salt")


def prefix_sums(index: DataFrame, part: str, seq: str, amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before each in the order of (part, seq).

    ``part`` numbers partitions. Sums are taken inside a part, inside blocks of 1,000 parts and
    over blocks, so no task meets more than the parts of a block or a row for each block.
    """
    block = F.floor(F.col(part) / 1000)
    parts = index.groupBy(part).agg(F.sum(amount).alias("__n")).withColumn("__block", block)
    blocks = parts.groupBy("__block").agg(F.sum("__n").alias("__bn"))

    def before(value: str, *keys: str, order: str) -> Column:
        over = Window.partitionBy(*keys).orderBy(order)
        return F.coalesce(
            F.sum(value).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )

    blocks = blocks.select("__block", before("__bn", order="__block").alias("__b0"))
    parts = parts.withColumn("__p0", before("__n", "__block", order=part)).join(blocks, "__block")
    parts = parts.select(F.col(part).alias("__part"), (F.col("__p0") + F.col("__b0")).alias("__p0"))
    inside = index.withColumn("__i0", before(amount, part, order=seq))
    return (
        inside.join(parts, F.col(part) == F.col("__part"))
        .withColumn(name, (F.col("__i0") + F.col("__p0")).cast("long"))
        .drop("__part", "__p0", "__i0")
    )


def slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes at most: first row, end row, bytes, row offsets.

    A longer row is a run of its own. Nulls have no bytes.
    """
    texts = texts.cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lengths = np.zeros(len(texts), np.int64)
    if len(texts):
        lengths = np.asarray(
            pa.compute.fill_null(pa.compute.binary_length(texts), 0), dtype=np.int64
        )
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        room = np.cumsum(lengths[first:])
        end = first + max(1, int(np.searchsorted(room, limit, side="right")))
        at = np.concatenate([[0], np.cumsum(lengths[first:end])]).astype(np.int64)
        whole = starts[end] - starts[first] == at[-1]
        if whole:
            part = raw[starts[first] : starts[end]]
        else:
            part = np.concatenate(
                [raw[starts[i] : starts[i] + lengths[i]] for i in range(first, end)]
            )
        yield first, end, part, at
        first = end
