"""Hard negatives against a brute-force walk of every anchor's rows."""

import math
import random

import pytest

from fileglade.llm import negatives


def brute(rows, every=100):
    clean = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id % 7 == 0:
            label = (label + 1) % 10
        clean[(vec_id, tuple(vector), label)] = [math.floor(256 * x) for x in vector]
    items = sorted(clean.items())
    out = set()
    for (aid, avec, alabel), aq in items:
        if aid % every:
            continue
        ranked = sorted(
            ((sum(x * y for x, y in zip(aq, q)), vid, key) for key, q in items for vid in [key[0]]),
            key=lambda t: (-t[0], t[1]),
        )
        pos = [t for t in ranked if t[2][2] == alabel and t[2] != (aid, avec, alabel)][:5]
        for ps, pid, _ in pos:
            negs = [t for t in ranked if t[2][2] != alabel and 80 * ps <= 100 * t[0] <= 100 * ps][:5]
            for rank, (ns, nid, _) in enumerate(negs, 1):
                out.add((aid, pid, rank, nid, ps, ns))
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, anchor_id string"
    )


@pytest.mark.parametrize("chunk,block", [(8192, 1024), (7, 2)])
def test_against_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
    rng = random.Random(3)
    rows = []
    for i in range(420):
        vector = [round(rng.uniform(-0.3, 0.3), 3) for _ in range(6)]
        rows.append((i, vector, rng.randrange(3)))
    rows += [(1000 + i, [0.1] * 6, i % 2) for i in range(30)]  # ties of one score
    rows += [rows[5], rows[100], (7, None, 1), (8, [0.1, float("nan")] + [0.0] * 4, 1), (9, [0.1] * 6, None),
             (None, [0.2] * 6, 1), (10, [0.1, None, 0, 0, 0, 0], 2), (200, [], 1), (300, [-0.2] * 6, 0)]
    rows = [(a, [float(x) if x is not None else None for x in v] if v is not None else None, c) for a, v, c in rows]
    got = {tuple(r) for r in negatives.mined(frame(spark, rows)).collect()}
    want = brute([(a, [x for x in v] if v is not None else None, c) for a, v, c in rows])
    assert want and got == want


def test_empty_and_no_anchor(spark):
    assert negatives.mined(frame(spark, [])).count() == 0
    assert negatives.mined(frame(spark, [(1, [0.5], 1), (2, [0.5], 2)])).count() == 0


def contract(rows):
    """Every row is a row, copies too."""
    taken = [
        (i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (aid, alabel, aq) in enumerate(taken):
        if aid % 100:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(aq, q)), i, label, k) for k, (i, label, q) in enumerate(taken))
        for ps, pid, _, _ in [t for t in ranked if t[2] == alabel and t[3] != at][:5]:
            fits = [t for t in ranked if t[2] != alabel and -80 * ps <= -100 * t[0] <= -100 * ps][:5]
            out += [(aid, pid, rank, nid, -ps, -ns) for rank, (ns, nid, _, _) in enumerate(fits, 1)]
    return sorted(out)


def query(spark, folder, rows):
    from fileglade.llm.queries import QUERIES

    frame(spark, rows).write.parquet(f"{folder}/embeddings.parquet")
    return sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, str(folder)).collect())


def test_query_counts_copies_as_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-40, 80)) / 256 for _ in range(4)], rng.randrange(2)) for i in range(260)]
    rows += [rows[i] for i in (0, 100, 100, 200, 14, 14)] + rng.sample(rows, 60)
    rows += [(500, [0.5, None, 0.5, 0.5], 1), (501, [0.5, float("inf"), 0.5, 0.5], 1), (502, None, 0)]
    want = contract(rows)
    assert len(want) > len(set(want)) and query(spark, tmp_path, rows) == want


@pytest.mark.parametrize("chunk,block", [(8192, 1024), (37, 2)])
def test_blocks_meet_chunks_without_coalesced_shuffles(spark, monkeypatch, tmp_path, chunk, block):
    monkeypatch.setattr(negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-40, 80)) / 256 for _ in range(4)], rng.randrange(3)) for i in range(350)]
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = query(spark, tmp_path, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = contract(rows)
    assert want and got == want


def test_large_components(spark, tmp_path):
    rows = [(100, [0.25, 1.0], 1), (101, [2.0**40, 0.0], 1), (102, [2.0**40 - 2.0**37, 0.0], 2)]
    assert query(spark, tmp_path, rows) == contract(rows) != []
