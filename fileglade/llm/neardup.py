"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

Elements of a text are its different five-word shingles. Each element sends a Poisson process of
arrivals at the rate of its weight to random registers; a register keeps the element that arrives
first. Two texts agree in a register with the probability of their probability Jaccard similarity;
all weights are 1 here, which makes it the Jaccard similarity of the sets, the one verified. A
text's process ends early: an element whose next arrival is later than all its registers has no
further say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileglade.llm.common import materialised, slices, worker_path
from fileglade.llm.components import components
from fileglade.llm.shingles import counted, mix, shingle_hashes

BANDS, ROWS = 16, 5
SIMILARITY = 0.8
#: Members that a task compares with each other at most about twice this number.
BLOCK = 1000


def prob_minhash(
    row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, registers: int
) -> np.ndarray:
    """The winning element of each register of each row; rows without elements have zeros."""
    first = np.full(n_rows * registers, np.inf)
    winner = np.zeros(n_rows * registers, np.uint64)
    time = np.zeros(len(row))
    step = 0
    while len(row):
        step += 1
        draw = mix(element + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight
        register = (mix(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(registers)).astype(np.int64)
        at = row * registers + register
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = element[won]
        rows, own = np.unique(row, return_inverse=True)
        last = first.reshape(n_rows, registers)[rows].max(axis=1)
        active = time <= last[own]
        row, element, weight, time = row[active], element[active], weight[active], time[active]
    return winner.reshape(n_rows, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
    for r in range(rows):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + parts[:, :, r])
    return key.view(np.int64)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text) and ``keys``, one for each band; null without words."""
    worker_path(docs.sparkSession)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch["text"]):
                row, value = shingle_hashes(data, at)
                row, value, _ = counted(row, value)
                n = end - first
                signature = prob_minhash(row, value, np.ones(len(row)), n, bands * rows)
                keys = band_keys(signature, bands, rows)
                empty = np.bincount(row, minlength=n) == 0
                offsets = np.arange(0, (n + 1) * bands, bands, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()), mask=pa.array(empty))
                own = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([own["doc_id"], own["h1"], own["h2"], lists], schema=schema)

    text = F.coalesce("text", F.lit(""))
    rows_in = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"),
        F.xxhash64(text, F.lit(1)).alias("h2"), text.alias("text"),
    )
    return rows_in.mapInArrow(run, "doc_id long, h1 long, h2 long, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """id and ``shingles``: the different shingle hashes, ascending, as 64-bit numbers."""
    worker_path(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, at in slices(batch["text"]):
                row, value, _ = counted(*shingle_hashes(data, at))
                bounds = np.searchsorted(row, np.arange(end - first + 1))
                sets = [value[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(first, end - first), pa.array(sets, pa.binary())], schema=schema
                )

    return docs.select("id", "text").mapInArrow(run, "id long, shingles binary")


def _similar(a: bytes, b: bytes, least: float) -> bool:
    small, large = sorted((len(a) // 8, len(b) // 8))
    if small < least * large:
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    common = len(x) + len(y) - len(np.union1d(x, y))
    return common >= least * (len(x) + len(y) - common) - 1e-9


def _verified(pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b, sa, sb) whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True)
            good = pa.array([_similar(x, y, least) for x, y in sets], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return pairs.mapInArrow(run, "a long, b long")


def _tree_links(ids: np.ndarray, known: np.ndarray, sets: list[bytes], least: float) -> list[tuple]:
    """Links that join all similar members: every pair is compared unless already joined."""
    own = [frozenset(np.frombuffer(s, np.uint64).tolist()) for s in sets]
    groups: dict[int, list[int]] = {}
    for i, k in enumerate(known.tolist()):
        groups.setdefault(k, []).append(i)
    joined: list[list[int]] = []
    links = []
    for new in groups.values():
        rest = []
        for old in joined:
            hit = next(
                (
                    (i, j)
                    for i in new
                    for j in old
                    if min(len(own[i]), len(own[j])) >= least * max(len(own[i]), len(own[j])) - 1e-9
                    and (c := len(own[i] & own[j])) >= least * (len(own[i]) + len(own[j]) - c) - 1e-9
                ),
                None,
            )
            if hit:
                links.append((int(ids[hit[0]]), int(ids[hit[1]])))
                new = new + old
            else:
                rest.append(old)
        joined = [*rest, new]
    return links


def _bucket_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links inside of buckets (key, id, known, n) that hold several known components."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    )
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "known"
    ).join(sets, "id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        links = _tree_links(frame["id"].to_numpy(), frame["known"].to_numpy(), list(frame["shingles"]), least)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and ``class_id``, the least doc_id of its near-duplicate class, for every row.

    Equal texts are one class; different ones are linked if their sets of five-word shingles (a
    shorter text is one shingle) have a Jaccard similarity of ``similarity`` or more, and links
    are followed. Texts without words are only in a class with equal ones; null texts are empty.
    Repeated rows share their class. Rows with a null doc_id come back with a null class.

    Different texts that share a band are compared first with the least of their bucket. Buckets
    that still hold several components are compared in full, pairs already joined left out; large
    ones are cut into blocks, a task for each pair of blocks. So links are lost only if two texts
    share no band: with a probability below 0.002 at a similarity of 0.8.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = materialised(signed(docs), spark)
    texts = sketched.filter(F.col("doc_id").isNotNull()).groupBy("h1", "h2").agg(
        F.min("doc_id").alias("id"), F.first("keys").alias("keys")
    )
    texts = materialised(texts, spark)
    banded = texts.select("id", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"))
    members = materialised(banded.join(buckets.filter("n > 1"), "key"), spark)
    stars = materialised(
        members.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), spark
    )
    wanted = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    # Repeated rows with one doc_id may differ in their texts: hashes pick the right one.
    wanted = wanted.join(texts.select("id", "h1", "h2"), "id")
    filled = F.coalesce("text", F.lit(""))
    hashed = docs.select("doc_id", filled.alias("text"), F.xxhash64(filled).alias("t1"))
    same = (F.col("doc_id") == F.col("id")) & (F.col("t1") == F.col("h1"))
    sets = materialised(shingle_sets(hashed.join(wanted, same).select("id", "text")).dropDuplicates(["id"]), spark)
    pairs = stars.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    links = materialised(_verified(pairs.select("a", "b", "sa", "sb"), similarity), spark)
    found = components(links)
    known = members.join(found.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left").select(
        "key", "id", "n", F.coalesce("label", "id").alias("known")
    )
    mixed = known.groupBy("key").agg(F.min("known").alias("lo"), F.max("known").alias("hi"))
    open_buckets = known.join(mixed.filter("lo < hi").select("key"), "key", "left_semi")
    more = materialised(_bucket_links(open_buckets, sets, similarity), spark)
    tree = found.select(F.col("id").alias("a"), F.col("label").alias("b"))
    found = components(tree.unionByName(more))
    of_text = texts.join(found.withColumnRenamed("id", "k"), F.col("id") == F.col("k"), "left").select(
        F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.coalesce("label", "id").alias("class_id")
    )
    rows = sketched.select("doc_id", "h1", "h2")
    joined = rows.join(of_text, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left")
    return joined.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the least doc_id; of repeated rows one stays.

    Rows with a null doc_id stay: nothing tells them apart.
    """
    found = classes(docs, similarity).filter("doc_id = class_id").select(F.col("doc_id").alias("__keep"))
    kept = docs.join(found.distinct(), F.col("doc_id") == F.col("__keep")).select(*docs.columns)
    # Rows that share a doc_id but not a text may be of several classes; each row of such a doc_id
    # that leads a class stays once.
    kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))
