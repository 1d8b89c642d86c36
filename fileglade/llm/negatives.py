"""Hard-negative mining by a secondary-sort shuffle.

Rows take part when their ``vec_id``, label and vector are set and every component is finite.
With ``copies`` every row counts, so a copy of an anchor is one of its other rows and an anchor
itself; without, exact copies of a row count once. A row whose ``vec_id`` is divisible by 7 first has its label
moved on by one (``(label + 1) % 10``). Components become ``floor(256 * x)`` and a row's score
for an anchor is the integer inner product (over the common length, should lengths differ).
Rows are ordered for an anchor by score, higher first, ties by smaller ``vec_id`` (then by a hash
of the vector, for rows that share an id). Anchors are the rows whose ``vec_id`` is divisible by
``every``. An anchor's positives are its first ``positives`` other rows of its label; for each,
the negatives are the first ``negatives`` rows of another label with
``low * positive_score <= 100 * negative_score <= 100 * positive_score``.

How it runs:

1. Anchors are dealt to blocks of at most ``ANCHOR_BLOCK`` and rows to chunks of about
   ``CHUNK_ROWS``; each (block, chunk) pair meets in one cogrouped task, so the anchors are
   scored against all rows in blocks and no task holds more than one block and one chunk.
2. The first pass keeps each anchor's first ``positives`` same-label rows of a chunk; a window
   over those few rows gives the positives' scores.
3. The second pass scores again and keeps, for each anchor, its first same-label rows and, for
   each positive score, the first qualifying rows of another label in the chunk. The global
   first rows of every window are among these, so nothing the answer needs is lost.
4. The kept pairs are packed into (anchor, descending score, id) keys, hash-partitioned by anchor
   and sorted within partitions; a streaming iterator walks each anchor's rows once, opens a
   window at each positive and emits negatives, holding only open windows and the first rows of
   the current score, never an anchor's rows.

Copies travel as one row with their number; only the stream counts them out.

Edge cases: an empty table, or one without anchors, gives no rows; an anchor with fewer
positives or negatives gives what there is; extra input columns are not carried. Scores must fit
in 63 bits; larger components raise an error instead of a wrong answer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fileglade.llm.common import worker_path

__all__ = ["mined"]

#: Anchors scored together in one task, and rows of one chunk; a task's score matrix is at most
#: their product.
ANCHOR_BLOCK = 1024
CHUNK_ROWS = 8192

_PAIRS = (
    "anchor_id long, anchor_dup long, anchor_copies long, vec_id long, dup long, copies long, score long, same boolean"
)
_NO_PAIRS = ["anchor_id", "anchor_dup", "anchor_copies", "vec_id", "dup", "copies", "score", "same"]
_RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
    "negative_score long"
)


def cleaned(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector, copies and dup of the rows that take part, exact copies as one."""
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return (
        embeddings.where(
            F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
        )
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            label.alias("label"),
            F.col("embedding").cast("array<double>").alias("vector"),
        )
        .groupBy("vec_id", "label", "vector")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("dup", F.xxhash64("label", "vector"))
    )


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(256.0 * out)
    return out


def _scores(anchors: pd.Series, rows: pd.Series) -> np.ndarray:
    """Exact integer inner products, anchors by rows."""
    width = max([len(v) for v in anchors] + [len(v) for v in rows] + [0])
    a, r = _matrix(anchors, width), _matrix(rows, width)
    if np.abs(a).max(initial=0) * np.abs(r).max(initial=0) * max(width, 1) >= 2.0**62:
        raise ValueError("components too large for exact 64-bit scores")
    return a.astype(np.int64) @ r.astype(np.int64).T


def _first(order_key: tuple[np.ndarray, ...], mask: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first ``k`` rows under ``mask`` in the order of (score desc, vec_id, dup)."""
    chosen = np.flatnonzero(mask)
    if len(chosen) <= k:
        return chosen
    score, vec_id, dup = (x[chosen] for x in order_key)
    bound = np.partition(-score, k - 1)[k - 1]
    near = chosen[-score <= bound]
    s, v, d = (x[near] for x in order_key)
    return near[np.lexsort((d, v, -s))[:k]]


def _pass(positives: int, negatives: int, low: int, second: bool):
    def run(key, rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or anchors.empty:
            return pd.DataFrame(columns=_NO_PAIRS)
        vec_id, dup, label, copies = (rows[c].to_numpy(np.int64) for c in ("vec_id", "dup", "label", "copies"))
        outs = []
        for start in range(0, len(anchors), ANCHOR_BLOCK):
            block = anchors.iloc[start : start + ANCHOR_BLOCK]
            scores = _scores(block["anchor_vector"], rows["vector"])
            for i, anchor in enumerate(block.itertuples(index=False)):
                s = scores[i]
                key3 = (s, vec_id, dup)
                own = (vec_id == anchor.anchor_id) & (dup == anchor.anchor_dup)
                others = copies - own
                same = (label == anchor.anchor_label) & (others > 0)
                picked = [_first(key3, same, positives)]
                if second:
                    other = label != anchor.anchor_label
                    tops = anchor.positive_scores
                    for ps in sorted(set(() if tops is None else np.asarray(tops).tolist())):
                        window = other & (s <= ps) & (s >= -(-low * ps // 100))
                        picked.append(_first(key3, window, negatives))
                at = np.unique(np.concatenate(picked))
                if len(at):
                    outs.append(pd.DataFrame({
                        "anchor_id": anchor.anchor_id, "anchor_dup": anchor.anchor_dup,
                        "anchor_copies": anchor.anchor_copies, "vec_id": vec_id[at], "dup": dup[at],
                        "copies": others[at], "score": s[at], "same": same[at],
                    }))
        if not outs:
            return pd.DataFrame(columns=_NO_PAIRS)
        return pd.concat(outs, ignore_index=True)

    return run


def _stream(positives: int, negatives: int, low: int):
    """Walks pairs sorted by (anchor, score desc, vec_id, dup) and emits the negatives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, found, windows, tie_score, ties, out = None, 0, [], None, [], []
        for batch in batches:
            for anchor, anchor_dup, times, vec_id, copies, score, same in zip(
                batch["anchor_id"].tolist(), batch["anchor_dup"].tolist(), batch["anchor_copies"].tolist(),
                batch["vec_id"].tolist(), batch["copies"].tolist(), batch["score"].tolist(), batch["same"].tolist(),
            ):
                if (anchor, anchor_dup) != current:
                    current, found, windows, tie_score, ties = (anchor, anchor_dup), 0, [], None, []
                if score != tie_score:
                    tie_score, ties = score, []
                if same:
                    for _ in range(min(copies, positives - found)):
                        found += 1
                        window = [score, vec_id, 0]
                        if score >= 0:
                            for negative in ties:
                                window[2] += 1
                                out.append((anchor, vec_id, window[2], negative, score, score, times))
                            if window[2] < negatives:
                                windows.append(window)
                    continue
                kept = []
                for window in windows:
                    ps, pid, n = window
                    if 100 * score < low * ps:
                        continue
                    if score <= ps:
                        for _ in range(min(copies, negatives - n)):
                            n += 1
                            out.append((anchor, pid, n, vec_id, ps, score, times))
                    if n < negatives:
                        window[2] = n
                        kept.append(window)
                windows = kept
                ties.extend([vec_id] * min(copies, negatives - len(ties)))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=_STREAMED)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_STREAMED)

    return run


_COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
_STREAMED = [*_COLUMNS, "times"]


def mined(
    embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80,
    copies: bool = False,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    With ``copies`` exact copies of a row are rows of their own, else they count once.
    """
    spark = embeddings.sparkSession
    worker_path(spark)
    rows = cleaned(embeddings)
    if not copies:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    anchors = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("anchor_id"), F.col("dup").alias("anchor_dup"), F.col("copies").alias("anchor_copies"),
        F.col("label").alias("anchor_label"), F.col("vector").alias("anchor_vector"),
    )
    n_anchors, n_rows = anchors.count(), rows.count()
    if n_anchors == 0:
        return spark.createDataFrame([], _RESULT)
    blocks, chunks = math.ceil(n_anchors / ANCHOR_BLOCK), math.ceil(n_rows / CHUNK_ROWS)
    # Both sides need keys of one type: an int and a long of one value hash to different tasks.
    spread = F.pmod(F.xxhash64("anchor_id", "anchor_dup"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("dup", "vec_id"), F.lit(chunks)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    anchors = anchors.withColumn("block", spread).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    )

    def scored(anchor_rows: DataFrame, second: bool) -> DataFrame:
        return (
            dealt.groupBy("block", "chunk")
            .cogroup(anchor_rows.groupBy("block", "chunk"))
            .applyInPandas(_pass(positives, negatives, low, second), _PAIRS)
        )

    first = scored(anchors.withColumn("positive_scores", F.lit(None).cast("array<long>")), False)
    order = Window.partitionBy("anchor_id", "anchor_dup").orderBy(F.desc("score"), "vec_id", "dup")
    tops = (
        first.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= positives)
        .groupBy("anchor_id", "anchor_dup")
        .agg(F.collect_list("score").alias("positive_scores"))
    )
    pairs = scored(anchors.join(tops, ["anchor_id", "anchor_dup"], "left"), True)
    ordered = pairs.repartition("anchor_id", "anchor_dup").sortWithinPartitions(
        "anchor_id", "anchor_dup", F.desc("score"), "vec_id", "dup"
    )
    found = ordered.mapInPandas(_stream(positives, negatives, low), f"{_RESULT}, times long")
    if copies:  # each copy of an anchor is an anchor
        found = found.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return found.select(*_COLUMNS)
