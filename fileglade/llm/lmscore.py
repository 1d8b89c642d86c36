"""Masked pseudo-likelihood: a window network predicts every token from both sides.

The symbols are the most frequent words of the corpus and, for all others, hashed classes. The
network adds an embedding for each of the two tokens on either side, applies tanh and predicts the
symbol between by a softmax. Every partition trains on all of its texts, from the same start; the
parameters are averaged by tokens, natively. A word without a symbol of its own has the probability
of its class times its share of the class in the corpus, from a table of all words. Tasks hold the
shares of common words, at most ``COMMON`` of them; those of all others are joined on Spark. The
score is the sum of log-probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, filterfalse, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileglade.llm.common import materialised, worker_path

TOP, HASHED, WIDTH, SIDE = 159, 32, 16, 2
#: Tokens of a gradient step, and the size that AdaGrad scales.
STEP_TOKENS, RATE = 4096, 0.1
#: Rows of a step whose probabilities are worked on together: they stay in a core's cache.
ROWS = 1024
#: Logits within this bound go into ``exp`` as they are: no sum or product leaves the range of floats.
SAFE = 60.0
#: Different words that a counting task holds before it sends them on.
HELD = 500_000
#: A word is common if it is at least one in so many of the words without a symbol of their own.
COMMON = 1_000_000


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word occurs in all texts; counted in the map tasks first.

    Words are bytes between ASCII blanks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def held() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            found = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return found

        for batch in batches:
            for text in batch["text"].cast(pa.binary()):
                counts.update((text.as_py() or b"").split())
                if len(counts) >= HELD:
                    yield held()
        if counts:
            yield held()

    words = docs.select(F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


class Tokens:
    """Token ids of texts: 0 stands for a text's edges, then the top words, then hashed classes.

    Words are bytes between ASCII blanks, as in ``word_counts``. ``known`` numbers the top words and
    then the ``common`` ones, whose classes are worked out once.
    """

    def __init__(self, top: list[str], hashed: int = HASHED, common: list[str] | None = None) -> None:
        self.size = 1 + len(top) + hashed
        self._top, self._classes = len(top), hashed
        self._powers = np.ones(1, np.uint32)
        own = [w.encode() for w in common or []]
        self.known = {w: i + 1 for i, w in enumerate([*(w.encode() for w in top), *own])}
        self._symbols = np.arange(1 + len(top) + len(own), dtype=np.int32)
        if own:
            self._symbols[1 + len(top) :] = self._class_ids(own)

    def ids(self, text: str) -> np.ndarray:
        return self.numbers(text.encode().split())

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return self.symbols(self.places(words), words)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers in ``known``, 0 for all others."""
        return np.fromiter(map(self.known.get, words, repeat(0)), np.int32, len(words))

    def symbols(self, places: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Ids of the words at these places."""
        own = self._symbols.take(places)
        others = np.flatnonzero(places == 0)
        if len(others):
            own[others] = self._class_ids([words[i] for i in others.tolist()])
        return own

    def _class_ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words' classes: a polynomial of each word's bytes modulo 2 ** 32, all at once."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        longest = int(lengths.max())
        if longest > len(self._powers):
            powers = np.full(2 * longest, 257, np.uint32)
            powers[0] = 1
            self._powers = np.multiply.accumulate(powers, dtype=np.uint32)
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32)
        terms = (raw + np.uint32(1)) * self._powers[np.repeat(ends - 1, lengths) - np.arange(len(raw))]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        value = sums[ends] - sums[ends - lengths] & np.uint64(0xFFFFFFFF)
        spread = value * np.uint64(2654435761) >> np.uint64(16) & np.uint64(0xFFFF)
        return 1 + self._top + (spread % np.uint64(self._classes)).astype(np.int32)

    def hashed(self, words: list[bytes]) -> tuple[list[bytes], list[int]]:
        """The different words that are not known, and how often each occurs."""
        found = Counter(filterfalse(self.known.__contains__, words))
        return list(found), list(found.values())


def start(size: int) -> np.ndarray:
    """The parameters before training, alike for every partition."""
    rng = np.random.default_rng(7)
    shape = 2 * SIDE * size * WIDTH + WIDTH * size + size
    return (rng.standard_normal(shape) * 0.1).astype(np.float32)


class Network:
    """Views of one vector of parameters."""

    def __init__(self, flat: np.ndarray, size: int) -> None:
        self.flat, self.size = flat, size
        a = 2 * SIDE * size * WIDTH
        self.embed = flat[:a].reshape(2 * SIDE, size, WIDTH)
        self.last = flat[a:].reshape(WIDTH + 1, size)  # the bias is the row below the weights
        self._room = np.empty((0, size), np.float32)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Values of the hidden units, and a column of ones that meets the bias."""
        total = self.embed[0].take(around[0], axis=0)
        for k in range(1, 2 * SIDE):
            total += self.embed[k].take(around[k], axis=0)
        h = np.ones((len(total), WIDTH + 1), np.float32)
        np.tanh(total, out=h[:, :WIDTH])
        return h

    def _exponentials(self, h: np.ndarray, target: np.ndarray, e: np.ndarray, safe: bool) -> np.ndarray:
        """Puts the exponentials of the rows' logits into ``e``; the logits of the targets. Unless
        they are safe, each row's greatest is subtracted from all of its logits."""
        np.matmul(h, self.last, out=e)
        if not safe:
            e -= e.max(axis=1)[:, None]
        own = e[np.arange(len(e)), target]
        np.exp(e, out=e)
        return own

    def _safe(self) -> bool:
        """Hidden units are within -1 and 1, which bounds the logits."""
        return bool(np.abs(self.last).sum(axis=0).max() < SAFE)

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        h, safe, ones = self.hidden(around), self._safe(), np.ones(self.size, np.float32)
        found = np.empty(len(h), np.float32)
        room = np.empty((min(ROWS, len(h)), self.size), np.float32)
        for a in range(0, len(h), ROWS):
            rows = slice(a, min(a + ROWS, len(h)))
            e = room[: rows.stop - a]
            found[rows] = self._exponentials(h[rows], target[rows], e, safe) - np.log(e @ ones)
        return found

    def step(self, around: np.ndarray, target: np.ndarray, squares: np.ndarray) -> None:
        """One AdaGrad step; ``squares`` sums the squared gradients so far.

        The error of a row is its exponentials, less their sum at the target, divided by that sum
        and the number of rows; the division is left to the narrow factors of each product.
        """
        gradient = np.zeros_like(self.flat)
        own = Network(gradient, self.size)
        h, safe, ones = self.hidden(around), self._safe(), np.ones(self.size, np.float32)
        if len(self._room) < len(h):
            self._room = np.empty((len(h), self.size), np.float32)
        error, sums = self._room[: len(h)], np.empty(len(h), np.float32)
        for a in range(0, len(h), ROWS):
            rows = slice(a, min(a + ROWS, len(h)))
            e = error[rows]
            self._exponentials(h[rows], target[rows], e, safe)
            np.matmul(e, ones, out=sums[rows])
            e[np.arange(len(e)), target[rows]] -= sums[rows]
        scale = (1 / (sums * np.float32(len(h))))[:, None]
        inner = error @ self.last[:WIDTH].T
        inner *= scale
        own.last[:] = (h * scale).T @ error
        h = h[:, :WIDTH]
        inner *= 1 - h * h
        for k in range(2 * SIDE):
            ids = around[k].astype(id_type(self.size))  # short integers sort by radix
            order = np.argsort(ids, kind="stable")
            sorted_ids = ids[order]
            heads = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
            own.embed[k][sorted_ids[heads]] = np.add.reduceat(inner.take(order, axis=0), heads, axis=0)
        squares += gradient * gradient
        self.flat -= RATE * gradient / (np.sqrt(squares) + 1e-8)


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What is around each token of each text, and the token."""
    edge = np.zeros(SIDE, ids[0].dtype if ids else np.int32)
    padded = np.concatenate([edge, *[x for i in ids for x in (i, edge)]])
    at = np.flatnonzero(padded)
    offsets = [k for k in range(-SIDE, SIDE + 1) if k]
    return np.stack([padded[at + k] for k in offsets]), padded[at]


def _encoded(docs: DataFrame, top: list[str], common: dict[str, float] | None = None) -> DataFrame:
    """A number for the row, doc_id, n_tokens and ``ids`` (the bytes of small integers) of each text;
    with ``common``, also the summed log-shares of its common words, and its words that are neither
    among the top nor common with their counts."""
    worker_path(docs.sparkSession)
    words = common is not None
    names, known = list(common or {}), np.array([0.0] * (1 + len(top)) + list((common or {}).values()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens(top, common=names)
        kind = id_type(tokens.size)

        def encoded(frame: pd.DataFrame, texts: list[list[bytes]]) -> pd.DataFrame:
            counts = np.array([len(t) for t in texts], np.int64)
            together = list(chain.from_iterable(texts))
            places = tokens.places(together)
            ids = np.split(tokens.symbols(places, together).astype(kind), np.cumsum(counts)[:-1])
            out = {"row": frame["row"], "doc_id": frame["doc_id"].astype("Int64"), "n_tokens": counts}
            out["ids"] = [i.tobytes() for i in ids]
            if words:
                owner = np.repeat(np.arange(len(texts)), counts)
                rare = [tokens.hashed(t) for t in texts]
                out["log_common"] = np.bincount(owner, known[places], minlength=len(texts))
                out |= {"words": [w for w, _ in rare], "counts": [n for _, n in rare]}
            return pd.DataFrame(out)

        for frame in frames:
            first, texts, waiting = 0, [], 0
            for i, text in enumerate(frame["text"]):
                split = text.encode().split() if isinstance(text, str) else []
                if texts and waiting + len(split) > 16 * STEP_TOKENS:
                    yield encoded(frame[first:i], texts)
                    first, texts, waiting = i, [], 0
                texts.append(split)
                waiting += len(split)
            if texts:
                yield encoded(frame[first:], texts)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    schema = "row long, doc_id long, n_tokens long, ids binary"
    if words:
        schema += ", log_common double, words array<binary>, counts array<int>"
    return rows.mapInPandas(run, schema)


def id_type(size: int) -> np.dtype:
    """The integers that the ids of so many symbols are kept in."""
    return np.min_scalar_type(size)


def train(docs: DataFrame, top: list[str]) -> np.ndarray:
    """Parameters after one pass of every partition over all of its texts."""
    return _fitted(_encoded(docs.select(F.lit(0).alias("doc_id"), "text"), top), 1 + len(top) + HASHED)


def _fitted(encoded: DataFrame, size: int) -> np.ndarray:
    """Parameters after one pass of every partition over all of its encoded texts.

    Partitions send their parameters as rows, so summing them needs no large message anywhere; the
    driver gets one vector of fixed size.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(start(size), size)
        kind = id_type(size)
        squares = np.zeros_like(net.flat)
        seen, held, waiting = 0, [], 0

        def learn() -> None:
            around, target = windows(held)
            for a in range(0, len(target), STEP_TOKENS):
                part = slice(a, a + STEP_TOKENS)
                net.step(around[:, part], target[part], squares)

        for frame in frames:
            for ids in frame["ids"]:
                if ids:
                    held.append(np.frombuffer(ids, kind))
                    waiting += len(held[-1])
                if waiting >= 16 * STEP_TOKENS:
                    learn()
                    seen, held, waiting = seen + waiting, [], 0
        if held:
            learn()
            seen += waiting
        if seen:
            yield pd.DataFrame({
                "i": np.arange(len(net.flat)), "x": net.flat.astype(float) * seen, "n": float(seen)
            })

    parts = encoded.select("ids").mapInPandas(run, "i long, x double, n double")
    mean = parts.groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()
    flat = start(size)
    flat[mean["i"].to_numpy()] = mean["x"].to_numpy()
    return flat


def _most_frequent(counts: DataFrame, top: int = TOP) -> list[str]:
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(top).collect()]


def vocabulary(docs: DataFrame, top: int = TOP) -> list[str]:
    """The most frequent words; ties in the order of the words."""
    return _most_frequent(materialised(word_counts(docs), docs.sparkSession), top)


def word_shares(counts: DataFrame, top: list[str]) -> DataFrame:
    """word, how often it occurs and ``log_share``, the log of its share of its class, for every word
    with no symbol of its own in the written table ``counts``."""
    spark = counts.sparkSession
    worker_path(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(top)
        for batch in batches:
            symbol = tokens.numbers(batch["word"].cast(pa.binary()).to_pylist())
            yield batch.append_column("symbol", pa.array(symbol)).filter(pa.array(symbol > len(top)))

    classed = materialised(counts.mapInArrow(run, "word string, n long, symbol int"), spark)
    totals = classed.groupBy("symbol").agg(F.sum("n").alias("total"))  # a row for each class
    share = F.log(F.col("n") / F.col("total"))
    return classed.join(F.broadcast(totals), "symbol").select("word", "n", share.alias("log_share"))


def common_shares(shares: DataFrame) -> dict[str, float]:
    """``log_share`` of the words that are at least one in ``COMMON`` of those in ``shares``, so
    there are no more than ``COMMON`` of them, whatever the corpus."""
    total = shares.agg(F.sum("n")).first()[0] or 0
    rows = shares.filter(F.col("n") >= max(1, -(-total // COMMON))).select("word", "log_share").toPandas()
    return dict(zip(rows["word"].tolist(), rows["log_share"].tolist(), strict=True))


def _rated(encoded: DataFrame, flat: np.ndarray, size: int) -> DataFrame:
    """The encoded texts with the summed log-probability of their symbols instead of their ids."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.drop("ids").schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Network(flat, size)
        kind = id_type(size)

        def rated(frame: pd.DataFrame) -> pd.DataFrame:
            around, target = windows([np.frombuffer(i, kind) for i in frame["ids"]])
            found = [
                net.log_probabilities(around[:, a : a + STEP_TOKENS], target[a : a + STEP_TOKENS])
                for a in range(0, len(target), STEP_TOKENS)
            ]
            total = np.zeros(len(frame))
            if found:
                owner = np.repeat(np.arange(len(frame)), frame["n_tokens"])
                total += np.bincount(owner, np.concatenate(found), minlength=len(frame))
            own = frame.drop(columns="ids").assign(log_symbols=total)
            return own.assign(doc_id=own["doc_id"].astype("Int64"))

        for frame in frames:
            ends = np.cumsum(frame["n_tokens"].to_numpy())
            first = 0
            while first < len(frame):
                before = ends[first - 1] if first else 0
                end = max(first + 1, int(np.searchsorted(ends, before + 16 * STEP_TOKENS, side="right")))
                yield rated(frame[first:end])
                first = end

    return encoded.mapInPandas(run, f"{schema}, log_symbols double")


def _results(rated: DataFrame, total: Column) -> DataFrame:
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return rated.select(
        "doc_id", "n_tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood")
    )


def scores(docs: DataFrame, top: list[str], flat: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, ``log_likelihood`` (summed) and ``mean_log_likelihood`` of the symbols of
    each text: of a word without a symbol of its own, only its class.

    A text without words, null ones too, has the sum 0 and a null mean. Repeated rows and null
    doc_ids are kept.
    """
    return _results(_rated(_encoded(docs, top), flat, 1 + len(top) + HASHED), F.col("log_symbols"))


def word_scores(docs: DataFrame, top: list[str], flat: np.ndarray, shares: DataFrame) -> DataFrame:
    """Like ``scores``, with the probability of every word itself.

    ``shares`` must have all words of the texts.
    """
    encoded = materialised(_encoded(docs, top, common_shares(shares)), docs.sparkSession)
    return _word_scores(encoded, flat, 1 + len(top) + HASHED, shares)


def _word_scores(encoded: DataFrame, flat: np.ndarray, size: int, shares: DataFrame) -> DataFrame:
    """Scores of the written table ``encoded``, which has the summed shares of common words.

    All others were counted for each text and are joined; none is common, so no key is hot.
    """
    names = ["row", "doc_id", "n_tokens", "ids", "log_common"]
    rated = materialised(_rated(encoded.select(*names), flat, size), encoded.sparkSession)
    rare = encoded.select("row", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    rare = rare.select("row", F.col("e.words").cast("string").alias("word"), F.col("e.counts").alias("n"))
    own = rare.join(shares.select("word", "log_share"), "word")
    own = own.groupBy("row").agg(F.sum(F.col("n") * F.col("log_share")).alias("own"))
    total = F.col("log_symbols") + F.col("log_common") + F.coalesce("own", F.lit(0.0))
    return _results(rated.join(own, "row", "left"), total)


def scored(docs: DataFrame) -> DataFrame:
    """Vocabulary, training and scores over all documents; texts are cut into words twice, to count
    them and to encode them."""
    counts = materialised(word_counts(docs), docs.sparkSession)
    top = _most_frequent(counts)
    size = 1 + len(top) + HASHED
    shares = word_shares(counts, top)
    encoded = materialised(_encoded(docs, top, common_shares(shares)), docs.sparkSession)
    return _word_scores(encoded, _fitted(encoded, size), size, shares)
