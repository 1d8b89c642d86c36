"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileglade.llm.bytebpe import byte_bpe, default_path
from fileglade.llm.common import materialised, prefix_sums, worker_path

MAX_LENGTH = 2048
END_ID = 1

_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, "
    "part long, nth long"
)


def binary_lengths(tokens: int, limit: int = MAX_LENGTH) -> list[int]:
    """Whole sequences first, then the binary digits of the rest, largest first."""
    rest = tokens % limit
    bits = [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]
    return [limit] * (tokens // limit) + bits


def pieces(
    docs: DataFrame, tokenizer: str | None = None, limit: int = MAX_LENGTH, end_id: int = END_ID
) -> DataFrame:
    """The pieces of each document (doc_id, text): place, length, ids, and a number in their task.

    ``limit`` must be a power of two. A null text is an empty one: its end id is its only piece.
    Repeated rows are packed each; a null doc_id stays null. No rows give no pieces.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    path = tokenizer or default_path()
    worker_path(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        + [("ids", pa.binary()), ("part", pa.int64()), ("nth", pa.int64())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_all = byte_bpe(path).encode_all
        part = TaskContext.get().partitionId()
        nth = dict.fromkeys((1 << b for b in range(limit.bit_length())), 0)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            found = encode_all(text.as_py() or "" for text in batch["text"])
            for doc, own_ids in zip(batch["doc_id"].to_pylist(), found, strict=True):
                ids = own_ids + end
                start, tokens = 0, len(ids) // 4
                for length in binary_lengths(tokens, limit):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(own), tokens, own, part, nth[length]))
                    nth[length] += 1
                    start += length
                size += len(ids)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                        schema=schema,
                    )
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)],
                    schema=schema,
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES)


def pack(cut: DataFrame) -> DataFrame:
    """Gives written ``pieces`` their sequences: bucketed by length, longest first.

    Every piece is a sequence of its own, of a power of two, so nothing is padded. Numbers run
    without gaps through a bucket and from bucket to bucket. ``cut`` is read twice, so it must be
    a written table: a recomputed task could number its pieces in another order.
    """
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__bucket", -F.col("length"))
    # A bucket's parts follow each other: the running number of (bucket, part) is their order.
    firsts = prefix_sums(counts, "__bucket", "part", "__n", "__first").select(
        F.col("length").alias("__length"), F.col("part").alias("__part"), "__first"
    )
    same = (F.col("length") == F.col("__length")) & (F.col("part") == F.col("__part"))
    return (
        cut.join(firsts, same)
        .withColumn("sequence_id", F.col("__first") + F.col("nth"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("__length", "__part", "__first", "part", "nth")
    )


def packed(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Documents to numbered sequences; ``keep_ids`` leaves the ids (little-endian 32-bit) in."""
    cut = pieces(docs, tokenizer)
    spark = docs.sparkSession
    return pack(materialised(cut if keep_ids else cut.drop("ids"), spark))
