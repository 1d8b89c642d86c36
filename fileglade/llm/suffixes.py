"""Removal of long byte strings that also start in an earlier document, by sorted suffixes.

Every ``LENGTH``-byte window has an anchor: the ``GRAM``-byte string in it with the least hash,
the leftmost of equals. Equal windows have equal anchors at the same place, so only suffixes at
anchors are sorted, and only at anchors that two documents share:

1. Texts are dealt to groups of some MB by document. A group sends its different anchors' hashes.
2. Where two groups, or two documents of a group, send one hash, the groups hear of it and send
   the bytes around these anchors, once for each different context, with its least document.
3. Contexts that share an anchor are sorted by deep-shallow sorting, to the right and, reversed,
   to the left. A window is its bytes left of the anchor's start and those right of it; windows
   are equal if both lie in runs of sufficiently long common prefixes. The least document of each
   window goes back to the groups that can lose bytes.
4. The groups remove the windows that start in a smaller document.

A hot passage is sent once by each group, never once by each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fileglade.llm.common import sized, slices, worker_path
from fileglade.llm.deepshallow import deep_shallow_sort
from fileglade.llm.shingles import mix

LENGTH, GRAM = 50, 24
SPREAD = LENGTH - GRAM + 1  # places of an anchor in a window
LEFT = SPREAD - 1
SHALLOW = 24
GROUP_MB = 8
#: Takes the place of a null doc_id: after all others.
LAST = np.iinfo(np.int64).max

_LETTERS = mix(np.arange(1001, 1257, dtype=np.uint64))
_FACTOR = 0xD1342543DE82EF95


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the ``GRAM`` bytes at each place; doubled from 1 to 16 bytes, then 16 + 8."""
    value, size, kept = _LETTERS[data], 1, None
    while size < 16:
        if size == 8:
            kept = value
        value = value[:-size] * np.uint64(pow(_FACTOR, size, 1 << 64)) + value[size:]
        size *= 2
    both = len(data) - GRAM + 1
    return mix(value[:both] * np.uint64(pow(_FACTOR, 8, 1 << 64)) + kept[16 : 16 + both])


def anchors(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, place and hash of each anchor, and the first and last start of its windows.

    ``rows`` are the offsets of texts in ``data``; no window crosses them.
    """
    none = np.zeros(0, np.int64)
    sizes = np.diff(rows)
    fit = np.maximum(sizes - LENGTH + 1, 0)
    if not fit.sum():
        return none, none, np.zeros(0, np.uint64), none, none
    hashes = gram_hashes(data)
    least = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= SPREAD:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPREAD:
        least = np.minimum(least[: len(hashes) - SPREAD + 1], least[SPREAD - size :])
    row = np.repeat(np.arange(len(sizes)), fit)
    start = np.arange(len(row)) - np.repeat(np.cumsum(fit) - fit, fit) + rows[:-1][row]
    place = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], place[first], hashes[place[first]], start[first], start[last]


def contexts(data: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row of bytes for each anchor: most and fewest bytes before it in a window, the bytes left
    of it from right to left, and those from its start on; zeros where no window reaches."""
    most, fewest = place - first, place - last
    out = np.zeros((len(place), 2 + LEFT + LENGTH), np.uint8)
    out[:, 0], out[:, 1] = most, fewest
    for k in range(LEFT):
        own = most > k
        out[own, 2 + k] = data[place[own] - 1 - k]
    for k in range(LENGTH):
        own = fewest + k < LENGTH
        out[own, 2 + LEFT + k] = data[place[own] + k]
    return out


def distinct(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each different row of bytes, and for each row the number of its like.

    Rows are told apart by a hash, which is then compared in full; should two different rows share
    one, the bytes themselves are sorted. Equal input gives equal numbers.
    """
    n, width = found.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = found
    words = padded.view(np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(words.shape[1]):
        code = mix(code * np.uint64(_FACTOR) + words[:, k])
    _, head, which = np.unique(code, return_index=True, return_inverse=True)
    which = which.ravel()
    if n and not (words[head[which]] == words).all():
        rows = np.ascontiguousarray(found).view(f"V{width}").ravel()
        _, head, which = np.unique(rows, return_index=True, return_inverse=True)
    return head, which.ravel()


def window_owners(found: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each context's window with ``a`` bytes before the anchor, by ``a``.

    ``found`` are contexts, ``doc`` their least documents. Places where a context has no window
    hold ``LAST``.
    """
    n = len(found)
    out = np.full((n, SPREAD), LAST)
    if not n:
        return out
    right = np.ascontiguousarray(found[:, 2 + LEFT :])
    order, common = deep_shallow_sort(right, SHALLOW)
    # Left contexts only matter among equal anchors: the anchor's number comes first.
    anchor = np.empty(n, np.int64)
    anchor[order] = np.cumsum(common < GRAM)
    left = np.zeros((n, 8 + LEFT), np.uint8)
    left[:, :8] = anchor.astype(">u8").view(np.uint8).reshape(n, 8)
    left[:, 8:] = found[:, 2 : 2 + LEFT]
    left_order, left_common = deep_shallow_sort(left, 16)
    for a in range(SPREAD):
        own = np.flatnonzero((found[:, 0] >= a) & (found[:, 1] <= a))
        if not len(own):
            continue
        r, x = np.empty(n, np.int64), np.empty(n, np.int64)
        r[order] = np.cumsum(common < LENGTH - a)
        x[left_order] = np.cumsum(left_common < 8 + a)
        key = r[own] * (n + 1) + x[own]
        by = np.argsort(key, kind="stable")
        heads = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        least = np.minimum.reduceat(doc[own][by], np.flatnonzero(heads))
        out[own[by], a] = least[np.cumsum(heads) - 1]
    return out


class _Group:
    """Anchors of the texts of a group."""

    def __init__(self, table: pa.Table) -> None:
        self.texts = table["text"].combine_chunks()
        ids = table["doc_id"].combine_chunks()
        self.doc = np.asarray(ids.fill_null(LAST))
        self.parts = list(slices(self.texts))
        rows, places, hashes, firsts, lasts, part = ([] for _ in range(6))
        for i, (begin, _, data, at) in enumerate(self.parts):
            row, place, code, first, last = anchors(data, at)
            for column, value in zip(
                (rows, places, hashes, firsts, lasts, part),
                (row + begin, place, code, first, last, np.full(len(row), i)),
                strict=True,
            ):
                column.append(value)
        join = lambda x, t=np.int64: np.concatenate(x) if x else np.zeros(0, t)
        self.row, self.place, self.first, self.last = map(join, (rows, places, firsts, lasts))
        self.part, self.code = join(part), join(hashes, np.uint64)

    def shared(self, hits: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the anchors among ``hits``, which ascend: their indexes, the different contexts, the context of
        each, and a bucket for each context."""
        short = _short(self.code, buckets)
        # A table of low bits first: most anchors are in no other text, and need no search.
        mask = np.uint64((1 << 22) - 1)
        known = np.zeros(1 << 22, bool)
        known[(hits & mask).astype(np.int64)] = True
        own = np.flatnonzero(known[(short & mask).astype(np.int64)])
        own = own[_among(short[own], hits)]
        found = np.zeros((len(own), 2 + LEFT + LENGTH), np.uint8)
        for i, (_, _, data, _) in enumerate(self.parts):
            here = np.flatnonzero(self.part[own] == i)
            at = own[here]
            found[here] = contexts(data, self.place[at], self.first[at], self.last[at])
        head, which = distinct(found)
        bucket = (self.code[own][head] % np.uint64(buckets)).astype(np.int64)
        return own, found[head], which, bucket


def _short(code: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket and 40 bits of a hash; hashes that agree in both only cost work."""
    bucket = code % np.uint64(buckets)
    return bucket << np.uint64(40) | code >> np.uint64(24)


def _among(x: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``hits``, which ascend; the work doesn't grow with unused hits."""
    if not len(hits):
        return np.zeros(len(x), bool)
    return hits[np.minimum(np.searchsorted(hits, x), len(hits) - 1)] == x


def _packed(short: np.ndarray) -> bytes:
    return np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(blob: bytes, bucket: int) -> np.ndarray:
    wide = np.zeros((len(blob) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel() | np.uint64(bucket << 40)


def _sorted_hits(table: pa.Table) -> np.ndarray:
    pairs = zip(table["bucket"].to_pylist(), table["hits"].to_pylist(), strict=True)
    blobs = [_unpacked(blob, bucket) for bucket, blob in pairs]
    return np.sort(np.concatenate(blobs)) if blobs else np.zeros(0, np.uint64)


def _table(schema: pa.Schema, columns: dict) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


_ANCHORS = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("once", pa.binary()), ("often", pa.binary())])
_HITS = pa.schema([("g", pa.int64()), ("bucket", pa.int64()), ("hits", pa.binary())])
_CONTEXTS = pa.schema(
    [("bucket", pa.int64()), ("g", pa.int64())]
    + [(c, pa.binary()) for c in ("contexts", "numbers", "least", "span")]
)
_OWNERS = pa.schema([("g", pa.int64())] + [(c, pa.binary()) for c in ("numbers", "low", "high", "owner")])
_RESULT = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    + [("kept_sha256", pa.string()), ("kept", pa.binary())]
)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def deduplicated(docs: DataFrame, keep_bytes: bool = True, carry: str | None = None) -> DataFrame:
    """What is left of each (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id; all is
    judged on the input. Texts are UTF-8; a null text is an empty one. Rows with equal doc_id take
    nothing from each other; a null doc_id comes after all others. ``kept`` may not be valid
    UTF-8 where a removed string ends inside a character. ``carry`` names a column to pass through.

    The text is shuffled once; the three steps that read it share that exchange. Tasks hold one
    group's texts, or one bucket's hashes or contexts; buckets grow in number with the input.
    """
    worker_path(docs.sparkSession)
    groups = sized(docs, "text", GROUP_MB)
    buckets = groups
    text = F.coalesce("text", F.lit("")).cast("binary")
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *([carry] if carry else []),
    )
    schema = StructType.fromDDL(_ddl(_RESULT))
    if carry:
        schema = schema.add(carry, docs.schema[carry].dataType)

    def send_anchors(key: tuple, table: pa.Table) -> pa.Table:
        group = _Group(table)
        short = _short(group.code, buckets)
        order = np.lexsort((group.row, short))
        short, row = short[order], group.row[order]
        heads = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, int)
        tails = np.append(heads[1:], len(short)) - 1
        several = row[heads] != row[tails]
        short = short[heads]
        bucket = (short >> np.uint64(40)).astype(np.int64)
        own = np.unique(bucket)
        a, b = np.searchsorted(bucket, own), np.searchsorted(bucket, own, side="right")
        spans = list(zip(a.tolist(), b.tolist(), strict=True))
        return _table(_ANCHORS, {
            "bucket": own, "g": np.full(len(own), key[0].as_py()),
            "once": [_packed(short[i:j][~several[i:j]]) for i, j in spans],
            "often": [_packed(short[i:j][several[i:j]]) for i, j in spans],
        })

    def match(key: tuple, table: pa.Table) -> pa.Table:
        bucket, g = key[0].as_py(), table["g"].to_pylist()
        once = [_unpacked(x, bucket) for x in table["once"].to_pylist()]
        often = [_unpacked(x, bucket) for x in table["often"].to_pylist()]
        every, count = np.unique(np.concatenate(once + often), return_counts=True)
        several = np.unique(np.concatenate(often))
        hits = np.union1d(every[count > 1], several)
        mine = [np.concatenate([x[_among(x, hits)], y]) for x, y in zip(once, often, strict=True)]
        some = [i for i, m in enumerate(mine) if len(m)]
        return _table(_HITS, {
            "g": [g[i] for i in some], "bucket": [bucket] * len(some), "hits": [_packed(mine[i]) for i in some],
        })

    def send_contexts(key: tuple, texts: pa.Table, hits: pa.Table) -> pa.Table:
        if not texts.num_rows or not hits.num_rows:
            return _CONTEXTS.empty_table()
        group = _Group(texts)
        own, found, which, bucket = group.shared(_sorted_hits(hits), buckets)
        doc = group.doc[group.row[own]]
        least, greatest = np.full(len(found), LAST), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(least, which, doc)
        np.maximum.at(greatest, which, doc)
        order = np.argsort(bucket, kind="stable")
        names, heads = np.unique(bucket[order], return_index=True)
        parts = np.split(order, heads[1:]) if len(order) else []
        return _table(_CONTEXTS, {
            "bucket": names, "g": np.full(len(names), key[0].as_py()),
            "contexts": [found[p].tobytes() for p in parts],
            "numbers": [p.astype("<u4").tobytes() for p in parts],
            "least": [least[p].astype("<i8").tobytes() for p in parts],
            "span": [(greatest - least)[p].astype("<i8").tobytes() for p in parts],
        })

    def sort_contexts(key: tuple, table: pa.Table) -> pa.Table:
        def column(name: str, kind: str) -> list[np.ndarray]:
            return [np.frombuffer(x, kind) for x in table[name].to_pylist()]

        numbers = column("numbers", "<u4")
        found = np.concatenate(column("contexts", "u1")).reshape(-1, 2 + LEFT + LENGTH)
        least = np.concatenate(column("least", "<i8"))
        greatest = least + np.concatenate(column("span", "<i8"))  # mostly zeros, which shrink when sent
        head, which = distinct(found)
        first = np.full(len(head), LAST)
        np.minimum.at(first, which, least)
        owner = window_owners(found[head], first)[which]
        sender = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
        number = np.concatenate(numbers)
        lose = owner < greatest[:, None]
        # Runs of windows with one owner, from few to many bytes before the anchor.
        same = np.zeros(owner.shape, bool)
        same[:, 1:] = lose[:, :-1] & (owner[:, 1:] == owner[:, :-1])
        begin = lose & ~same
        end = lose.copy()
        end[:, :-1] &= ~(lose[:, 1:] & same[:, 1:])
        rec, low = np.nonzero(begin)
        _, high = np.nonzero(end)
        g = table["g"].to_pylist()
        order = np.argsort(sender[rec], kind="stable")
        names, heads = np.unique(sender[rec][order], return_index=True)
        parts = np.split(order, heads[1:]) if len(order) else []
        return _table(_OWNERS, {
            "g": [g[i] for i in names],
            "numbers": [number[rec[p]].astype("<u4").tobytes() for p in parts],
            "low": [low[p].astype(np.uint8).tobytes() for p in parts],
            "high": [high[p].astype(np.uint8).tobytes() for p in parts],
            "owner": [owner[rec[p], low[p]].astype("<i8").tobytes() for p in parts],
        })

    def remove(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            none = _RESULT.empty_table()
            return none.append_column(carry, texts[carry]) if carry else none
        hits = answers.filter(pa.compute.is_valid(answers["hits"]))
        answers = answers.filter(pa.compute.is_valid(answers["owner"]))
        marks: list[tuple[np.ndarray, ...]] = []
        group = _Group(texts)
        if answers.num_rows:
            own, _, which, _ = group.shared(_sorted_hits(hits), buckets)

            def column(name: str, kind: str) -> np.ndarray:
                return np.concatenate([np.frombuffer(x, kind) for x in answers[name].to_pylist()])

            number, owner = column("numbers", "<u4").astype(np.int64), column("owner", "<i8")
            low, high = column("low", "u1").astype(np.int64), column("high", "u1").astype(np.int64)
            by = np.argsort(which, kind="stable")
            a = np.searchsorted(which[by], number)
            times = np.searchsorted(which[by], number, side="right") - a
            run = np.repeat(np.arange(len(number)), times)
            nth = np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
            at = own[by[a[run] + nth]]
            gone = owner[run] < group.doc[group.row[at]]
            at, run = at[gone], run[gone]
            marks = [(group.part[at], group.place[at] - high[run], group.place[at] - low[run] + LENGTH)]
        counts, spans, digests, kept = [], [], [], []
        for i, (_, _, data, rows) in enumerate(group.parts):
            steps = np.zeros(len(data) + 1, np.int64)
            for part, begin, end in marks:
                np.add.at(steps, begin[part == i], 1)
                np.add.at(steps, end[part == i], -1)
            gone = np.cumsum(steps[:-1]) > 0
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            edges = rows[:-1][np.diff(rows) > 0]
            head[edges] = gone[edges]
            removed = np.concatenate([[0], np.cumsum(gone)])[rows]
            begun = np.concatenate([[0], np.cumsum(head)])[rows]
            left = data[~gone].tobytes()
            place = rows - removed
            texts_left = [left[a:b] for a, b in zip(place[:-1], place[1:], strict=True)]
            counts.append(np.diff(removed))
            spans.append(np.diff(begun))
            digests += [hashlib.sha256(x).hexdigest() for x in texts_left]
            kept += texts_left if keep_bytes else [None] * len(texts_left)
        ids = np.concatenate([np.diff(p[3]) for p in group.parts])
        out = _table(_RESULT, {
            "doc_id": texts["doc_id"].combine_chunks(), "n_bytes": ids, "n_removed": np.concatenate(counts),
            "n_spans": np.concatenate(spans), "kept_sha256": digests, "kept": kept,
        })
        return out.append_column(carry, texts[carry]) if carry else out

    by_group = dealt.groupBy("g")
    sent = by_group.applyInArrow(send_anchors, _ddl(_ANCHORS))
    hits = sent.groupBy("bucket").applyInArrow(match, _ddl(_HITS))
    around = by_group.cogroup(hits.groupBy("g")).applyInArrow(send_contexts, _ddl(_CONTEXTS))
    owners = around.groupBy("bucket").applyInArrow(sort_contexts, _ddl(_OWNERS))
    answers = owners.unionByName(hits, allowMissingColumns=True)
    result = by_group.cogroup(answers.groupBy("g")).applyInArrow(remove, schema)
    return result if keep_bytes else result.drop("kept")


def documents_without_repeats(docs: DataFrame) -> DataFrame:
    """Documents with what ``deduplicated`` leaves of their texts, and all their other columns.

    Rows pass through beside their texts, so repeated and null doc_ids are no matter.
    """
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(F.col("text").isNull().alias("no_text"), *[F.col(c).alias(f"c_{c}") for c in others])
    left = deduplicated(docs.select("doc_id", "text", row.alias("row")), carry="row")
    text = F.when(~F.col("row.no_text"), F.make_valid_utf8(F.col("kept").cast("string"))).alias("text")
    return left.select(*[text if c == "text" else F.col("row").getField(f"c_{c}").alias(c) for c in docs.columns])
