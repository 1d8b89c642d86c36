"""Near duplicates, repeated passages, sorting and components against brute force."""

import hashlib
import random

import numpy as np
import pytest

from fileglade.llm import components, deepshallow, neardup, suffixes
from fileglade.llm.common import materialised


def shingles(text):
    words = (text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    label = {d: d for d, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    sets = [(d, t, shingles(t)) for d, t in rows]
    for i, (a, ta, sa) in enumerate(sets):
        for b, tb, sb in sets[:i]:
            if ta == tb or (sa and len(sa & sb) >= 0.8 * len(sa | sb)):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {d: root(d) for d in label}


@pytest.mark.parametrize("block", [1000, 3])
def test_classes(spark, documents, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    base = [f"word{i}" for i in range(60)]
    chain = []
    for i in range(40):  # neighbours are alike, the ends are not
        chain.append((2000 + i, " ".join(base)))
        base[rng.randrange(len(base))] = f"new{i}"
    more = spark.createDataFrame(chain, "doc_id long, text string")
    rows = documents.select("doc_id", "text").unionByName(more)
    found = {r.doc_id: r.class_id for r in neardup.classes(rows).collect()}
    assert found == brute_classes([tuple(r) for r in rows.collect()])


def test_classes_of_odd_rows(edge, empty):
    rows = neardup.classes(edge).collect()
    assert len(rows) == edge.count()
    assert {r.class_id for r in rows if r.doc_id in (1, 2)} == {1}
    kept = neardup.one_of_each(edge)
    assert kept.columns == edge.columns and kept.filter("doc_id = 5").count() == 1
    assert neardup.classes(empty).count() == 0


def test_copies_that_repeat_a_line_differently(spark):
    rows = []
    for i in range(12):
        text, line = (" ".join(f"{c}{i}_{k}" for k in range(n)) for c, n in (("w", 500), ("m", 10)))
        for j, n in enumerate((20, 200)):
            rows.append((2 * i + j, "\n".join([text, *[line] * n])))
    found = {r.doc_id: r.class_id for r in neardup.classes(
        spark.createDataFrame(rows, "doc_id long, text string")
    ).collect()}
    assert found == {d: d - d % 2 for d, _ in rows}


def test_probability_jaccard():
    rng = np.random.default_rng(0)
    element = rng.integers(1, 2**63, 300).astype(np.uint64)
    a, b = element[:200], element[100:]
    wa, wb = rng.integers(1, 4, 200).astype(float), rng.integers(1, 4, 200).astype(float)
    row = np.repeat([0, 1], 200)
    signature = neardup.prob_minhash(row, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4000)
    x, y = dict(zip(a, wa, strict=True)), dict(zip(b, wb, strict=True))
    every = set(x) | set(y)
    exact = sum(
        1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y)
    )
    assert abs((signature[0] == signature[1]).mean() - exact) < 0.03


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)]
    frame = materialised(spark.createDataFrame(links, "a long, b long"), spark)
    label = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.id: r.label for r in components.components(frame).collect()}
    assert found == {k: v for k, v in label.items() if any(k in p and p[0] != p[1] for p in links)}


def test_deep_shallow_sort():
    rng = np.random.default_rng(1)
    for case in range(80):
        n, length = int(rng.integers(0, 300)), int(rng.integers(1, 40))
        texts = rng.integers(0, 2, (n, length)).astype(np.uint8)
        if case % 2:
            texts[:, : rng.integers(0, length + 1)] = 1
        order, common = deepshallow.deep_shallow_sort(texts, 8)
        rows = [bytes(texts[i]) for i in order]
        assert rows == sorted(rows)
        for i in range(1, n):
            k = next((k for k in range(length) if rows[i][k] != rows[i - 1][k]), length)
            assert k == common[i]


def test_large_segments_are_partitioned(monkeypatch):
    monkeypatch.setattr(deepshallow, "SMALL", 4)
    words = np.random.default_rng(2).integers(0, 3, (500, 3)).astype(np.uint64)
    order = deepshallow.multikey_quicksort(words)
    assert [tuple(r) for r in words[order]] == sorted(tuple(r) for r in words)


def brute_repeats(docs):
    first = {}
    for d, t in docs:
        data = (t or "").encode()
        for i in range(len(data) - 49):
            key = data[i : i + 50]
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        out.setdefault(d, []).append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


@pytest.mark.parametrize("groups", [1, 6])
def test_repeats(spark, documents, monkeypatch, groups):
    monkeypatch.setattr(suffixes, "sized", lambda *_: groups)
    rng = random.Random(3)
    base = ["".join(rng.choices("abé ", k=rng.randint(0, 300))) for _ in range(20)]
    rows = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            text = rng.choice(base)
            a, b = sorted((rng.randint(0, len(text)), rng.randint(0, len(text))))
            parts.append(text[a:b] + "a" * rng.choice([0, 0, 90]))
        rows.append((rng.randint(2000, 2100), "".join(parts) if rng.random() > 0.05 else None))
    frame = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {}
    for r in suffixes.deduplicated(frame).collect():
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {d: sorted(v) for d, v in found.items()} == brute_repeats([tuple(r) for r in frame.collect()])


def test_repeats_of_odd_rows(edge, empty):
    assert suffixes.deduplicated(edge).count() == edge.count()
    left = suffixes.documents_without_repeats(edge)
    assert left.columns == edge.columns
    assert left.filter("doc_id = 1").first().text is None
    assert suffixes.documents_without_repeats(empty).count() == 0
