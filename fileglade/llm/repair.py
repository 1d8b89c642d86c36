"""Token-id files compressed by Re-Pair grammars, one per shard, with random-access decoding.

A file row is a shard: some consecutive documents in ascending doc_id order. Its columns:

* ``part``, ``seq``: place of the shard in the order; ``n_docs``, ``n_ids``: what it holds.
* ``doc_ids``: int64, and ``doc_nulls``: a byte each, 1 for a null doc_id (ids little-endian).
* ``starts``: uint64 for each document and the end: its first id in the shard.
* ``symbols``: the compressed sequence, uint16. Values below ``base`` index ``alphabet``.
* ``alphabet``: uint32, the distinct ids of the shard in ascending order.
* ``rules``: uint16 pairs; rule r replaces symbol ``base + r`` by its pair of earlier symbols.
* ``lengths``: uint32, the ids that each rule expands to.
* ``marks``: uint64, ids before every ``MARK_EVERY``-th symbol, to find an id without a scan.

A shard whose alphabet leaves no room for rules in 16 bits is cut in two until it does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileglade.llm.bytebpe import byte_bpe, default_path
from fileglade.llm.common import prefix_sums, sized, worker_path
from fileglade.sources.storage import shared_folder

END_ID = 2
SHARD_IDS = 2_000_000
MARK_EVERY = 1024
#: A pair must occur so often to get a rule; rounds of counting; rules made in one round at most.
MIN_COUNT, ROUNDS, ROUND_RULES = 8, 6, 6144
_SYMBOLS = 1 << 16
_SLOT_BITS = 20

_BLOBS = ("doc_ids", "doc_nulls", "starts", "symbols", "alphabet", "rules", "lengths", "marks")
_FIELDS = [("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
SCHEMA = pa.schema([*_FIELDS, *[(b, pa.binary()) for b in _BLOBS]])
DDL = "part long, seq long, n_docs long, n_ids long, " + ", ".join(f"{b} binary" for b in _BLOBS)


def _pair_codes(symbols: np.ndarray) -> np.ndarray:
    return symbols[:-1].astype(np.uint32) << np.uint32(16) | symbols[1:]


def compress(symbols: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the rules (pairs of uint16) after replacing frequent pairs.

    Each round counts all pairs, gives the most frequent ones a nonterminal each and replaces
    their occurrences; where two overlap, the more frequent pair goes first, then the left one. A
    round takes many pairs at once, in the order of their counts, so a shard needs few passes.
    """
    rules = np.zeros((0, 2), np.uint16)
    for _ in range(ROUNDS):
        room = _SYMBOLS - base - len(rules)
        if room <= 0 or len(symbols) < 2:
            break
        codes = _pair_codes(symbols)
        ordered = np.sort(codes)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(edges, len(ordered)))
        often = np.flatnonzero(counts >= MIN_COUNT)
        if not len(often):
            break
        best = often[np.lexsort((ordered[edges[often]], -counts[often]))][: min(room, ROUND_RULES)]
        pairs = ordered[edges[best]]
        # A slot holds one pair, the most frequent of those that hash to it; the others wait.
        slots = np.full(1 << _SLOT_BITS, -1, np.int16)
        slots[_slot(pairs[::-1])] = np.arange(len(pairs) - 1, -1, -1)
        rank = slots[_slot(codes)]
        places = np.flatnonzero((rank >= 0) & (pairs[rank] == codes))
        places, rank = _disjoint(places, rank[places])
        used = np.bincount(rank, minlength=len(pairs))
        worth = used >= 3  # a rule costs two symbols
        number = np.cumsum(worth) - 1
        places, rank = places[worth[rank]], rank[worth[rank]]
        if not len(places):
            break
        first = base + len(rules)
        symbols[places] = (first + number[rank]).astype(np.uint16)
        stay = np.ones(len(symbols), bool)
        stay[places + 1] = False
        symbols = symbols[stay]
        new = pairs[worth]
        rules = np.concatenate([rules, np.stack([new >> 16, new & 0xFFFF], 1).astype(np.uint16)])
        if len(places) < len(codes) // 100:
            break
    return symbols, rules


def _slot(codes: np.ndarray) -> np.ndarray:
    return codes * np.uint32(0x9E3779B1) >> np.uint32(32 - _SLOT_BITS)


def _disjoint(places: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (ascending places) that don't overlap: of two that do, the one of lower rank
    goes first, of equals the one at an even place, so that runs are halved at once.

    Two passes; what is still undecided then is counted again in the next round.
    """
    chosen = []
    for _ in range(2):
        key = rank.astype(np.int32) * 2 + (places & 1)
        apart = places[1:] != places[:-1] + 1
        less = key[1:] < key[:-1]
        won = np.ones(len(places), bool)
        won[1:] = apart | less
        won[:-1] &= apart | ~less
        chosen.append((places[won], rank[won]))
        gone = won.copy()
        gone[1:] |= won[:-1] & ~apart
        gone[:-1] |= won[1:] & ~apart
        places, rank = places[~gone], rank[~gone]
    return np.concatenate([c[0] for c in chosen]), np.concatenate([c[1] for c in chosen])


def expansion_lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """Ids that each symbol below ``base`` (one) and each rule stands for."""
    lengths = np.ones(base + len(rules), np.int64)
    done = base
    while done < len(lengths):  # rules of one round only use earlier rounds' symbols
        left, right = rules[done - base :, 0].astype(int), rules[done - base :, 1].astype(int)
        ready = np.flatnonzero(np.maximum(left, right) >= done)
        end = done + (int(ready[0]) if len(ready) else len(left))
        lengths[done:end] = (lengths[left] + lengths[right])[: end - done]
        done = end
    return lengths


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The sequence of symbols below ``base``.

    All rules are expanded once, one after the other; the rules of a round have disjoint
    occurrences, so together they are no longer than the sequence.
    """
    own = np.arange(base, dtype="<u2").tobytes()
    parts = [own[i : i + 2] for i in range(0, 2 * base, 2)]
    for left, right in rules.tolist():
        parts.append(parts[left] + parts[right])
    flat = np.frombuffer(b"".join(parts), "<u2")
    length = np.array([len(p) // 2 for p in parts], np.int64)
    first = np.cumsum(length) - length
    width = length[symbols]
    at = np.repeat(first[symbols] - (np.cumsum(width) - width), width)
    return flat[at + np.arange(len(at))]


def shard_rows(docs: list, ids: list[bytes], part: int, seq: int) -> Iterator[dict]:
    """File rows of some documents' ids; one, unless the alphabet is too large for 16 bits."""
    whole = np.frombuffer(b"".join(ids), "<u4")
    seen = np.zeros(int(whole.max(initial=0)) + 1, bool)
    seen[whole] = True
    alphabet = np.flatnonzero(seen)
    if len(alphabet) >= _SYMBOLS - 256 and len(docs) > 1:
        half = len(docs) // 2
        for row in shard_rows(docs[:half], ids[:half], part, seq):
            yield row
            seq = row["seq"] + 1
        yield from shard_rows(docs[half:], ids[half:], part, seq)
        return
    if len(alphabet) > _SYMBOLS:
        raise ValueError("a document with more than 65536 distinct ids needs wider symbols")
    base = len(alphabet)
    places = np.zeros(len(seen), np.uint16)
    places[alphabet] = np.arange(base)
    symbols, rules = compress(places[whole], base)
    lengths = expansion_lengths(base, rules)
    marks = (np.cumsum(lengths[symbols]) - lengths[symbols])[::MARK_EVERY]
    starts = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])])
    blobs = (
        np.array([d or 0 for d in docs], "<i8"),
        np.array([d is None for d in docs], np.uint8),
        starts.astype("<u8"),
        symbols.astype("<u2"),
        alphabet.astype("<u4"),
        rules.astype("<u2"),
        lengths[base:].astype("<u4"),
        marks.astype("<u8"),
    )
    row = {"part": part, "seq": seq, "n_docs": len(docs), "n_ids": len(whole)}
    yield row | {name: blob.tobytes() for name, blob in zip(_BLOBS, blobs, strict=True)}


def shard_ids(row: dict) -> np.ndarray:
    """All ids of a shard."""
    alphabet = np.frombuffer(row["alphabet"], "<u4")
    rules = np.frombuffer(row["rules"], "<u2").reshape(-1, 2)
    symbols = np.frombuffer(row["symbols"], "<u2")
    return alphabet[expand(symbols, len(alphabet), rules)]


def read_range(row: dict, start: int, length: int) -> np.ndarray:
    """``length`` ids of a shard from id ``start`` on; only the symbols over them are expanded."""
    alphabet = np.frombuffer(row["alphabet"], "<u4")
    rules = np.frombuffer(row["rules"], "<u2").reshape(-1, 2)
    symbols = np.frombuffer(row["symbols"], "<u2")
    marks = np.frombuffer(row["marks"], "<u8")
    lengths = np.concatenate([np.ones(len(alphabet), np.int64), np.frombuffer(row["lengths"], "<u4")])
    if not length:
        return alphabet[:0]
    first = int(np.searchsorted(marks, start, side="right")) - 1
    last = int(np.searchsorted(marks, start + length, side="left"))
    own = symbols[first * MARK_EVERY : last * MARK_EVERY]
    ends = int(marks[first]) + np.cumsum(lengths[own])
    a = int(np.searchsorted(ends, start, side="right"))
    b = int(np.searchsorted(ends, start + length, side="left")) + 1
    before = int(ends[a] - lengths[own[a]])
    ids = alphabet[expand(own[a:b], len(alphabet), rules)]
    return ids[start - before : start - before + length]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the ids of (doc_id, text) to ``path`` in ascending doc_id order, nulls first.

    One shuffle deals the texts to ranges of doc_id; a task then holds one shard's ids at a time.
    A null text is an empty one and has only its end id. Rows with equal doc_id follow each other
    in the order of their texts. No rows give an empty file.
    """
    tokens = tokenizer or default_path()
    worker_path(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_all = byte_bpe(tokens).encode_all
        part, seq = TaskContext.get().partitionId(), 0
        docs: list = []
        ids: list[bytes] = []
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal docs, ids, held, seq
            for row in shard_rows(docs, ids, part, seq):
                seq = row["seq"] + 1
                yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)
            docs, ids, held = [], [], 0

        for batch in batches:
            found = encode_all(text.as_py() or "" for text in batch["text"])
            for doc, own in zip(batch["doc_id"].to_pylist(), found, strict=True):
                docs.append(doc)
                ids.append(own + end)
                held += len(ids[-1]) // 4
                if held >= SHARD_IDS:
                    yield from rows()
        if docs:
            yield from rows()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = texts.repartitionByRange(sized(texts, "text", 16), "doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(shards, DDL).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each document's place and ids from the file: doc_id, start, n_tokens, ids_crc32, ids.

    ``start`` counts the ids of all documents before it. Only shard sizes are summed for that.
    """
    files = spark.read.schema(DDL).parquet(path)
    worker_path(spark)
    offsets = prefix_sums(files.select("part", "seq", "n_ids"), "part", "seq", "n_ids", "first")
    schema = pa.schema(
        [("__part", pa.int64()), ("__seq", pa.int64()), ("doc_id", pa.int64()), ("local", pa.int64())]
        + [("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = shard_ids(row).astype("<u4").tobytes()
                starts = np.frombuffer(row["starts"], "<u8").astype(np.int64)
                nulls = np.frombuffer(row["doc_nulls"], np.uint8).astype(bool)
                own = [ids[4 * a : 4 * b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int64()),
                        pa.array([row["seq"]] * n, pa.int64()),
                        pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=nulls),
                        pa.array(starts[:-1]),
                        pa.array(np.diff(starts)),
                        pa.array([zlib.crc32(o) for o in own], pa.int64()),
                        pa.array(own, pa.binary()),
                    ],
                    schema=schema,
                )

    # A shard is large: few of them may be in one Arrow batch.
    found = files.mapInArrow(
        documents,
        "__part long, __seq long, doc_id long, local long, n_tokens long, ids_crc32 long, ids binary",
    )
    same = (F.col("part") == F.col("__part")) & (F.col("seq") == F.col("__seq"))
    return found.join(offsets, same).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "ids"
    )


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Documents written to a new file in the shared folder and read back."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/ids"
    write(docs, path, tokenizer)
    return read(spark, path)
