"""Toxicity by held-out accuracy, window network by its probabilities, and the pipeline."""

import os
import sys
from collections import Counter

import numpy as np

import corpus_pipeline
from fileglade.llm import lmscore, toxicity
from fileglade.llm.common import materialised, table

SF = os.environ.get("TEST_SF_DIR_LLM", "/root/testdata/sf0.1")


def test_held_out_toxicity(spark, edge, empty):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    held = labels.filter("doc_id % 3 = 0")
    found = toxicity.severities(docs, model).withColumnRenamed("toxic", "found")
    rows = found.join(held, "doc_id").collect()
    right = np.mean([r.found == (r.toxic > 0) for r in rows])
    caught = np.mean([r.found for r in rows if r.toxic])
    assert right > 0.95 and caught > 0.8
    assert toxicity.severities(edge, model).count() == edge.count()
    assert toxicity.severities(empty, model).count() == 0
    none = toxicity.train(empty, labels.limit(0))
    assert toxicity.severities(edge, none).filter("toxic").count() == 0


def test_thresholds_share_weights():
    rng = np.random.default_rng(0)
    bags, grades = [], []
    for _ in range(600):
        grade = int(rng.integers(0, 3))
        bag = {f"n{i}" for i in rng.integers(0, 50, 12)} | {f"bad{i}" for i in range(4 * grade)}
        bags.append(sorted(bag))
        grades.append(grade)
    model = toxicity.fit(bags, np.array(grades))
    p = model.probabilities(np.array([model.score(" ".join(b)) for b in ([], ["bada"], ["badb"])]))
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(model.thresholds) > 0).all()
    assert abs(model.weights.get("n1", 0)) < abs(model.weights["bad1"])


def test_window_network(documents, edge, empty):
    top = lmscore.vocabulary(documents, 60)
    flat = lmscore.train(documents, top)
    size = 1 + len(top) + lmscore.HASHED
    net = lmscore.Network(flat, size)
    around = np.tile(np.array([[1], [2], [3], [0]]), size)
    p = np.exp(net.log_probabilities(around, np.arange(size)))
    assert abs(p.sum() - 1) < 1e-4
    rows = lmscore.scores(documents, top, flat).collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.log_likelihood for r in rows) / tokens > -np.log(size)
    odd = {r.doc_id: r for r in lmscore.scores(edge, top, flat).collect()}
    assert odd[1].log_likelihood == 0 and odd[1].mean_log_likelihood is None
    assert lmscore.scored(empty).count() == 0


def test_every_word_has_its_own_probability(spark, documents):
    texts = ["na ba " * 30 + f"rare{i} rare{i % 3} mid{i % 2}\u00a0x" for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(docs.limit(3)).unionByName(documents.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    words = Counter(w for _, t in rows for w in t.encode().split())
    counts = materialised(lmscore.word_counts(docs), spark)
    top = [r.word for r in counts.orderBy("n", ascending=False).limit(20).collect()]
    tokens = lmscore.Tokens(top)
    symbol = dict(zip(words, tokens.numbers(list(words)).tolist(), strict=True))
    classes = Counter()
    for w, n in words.items():
        classes[symbol[w]] += n

    flat = lmscore.train(docs, top)
    shares = lmscore.word_shares(counts, top)
    shared = {r.word.encode(): r.log_share for r in shares.collect()}
    assert set(shared) == {w for w in words if symbol[w] > len(top)}
    for k in range(len(top) + 1, tokens.size):
        own = [np.exp(x) for w, x in shared.items() if symbol[w] == k]
        assert not own or abs(sum(own) - 1) < 1e-9

    plain = sorted(tuple(r) for r in lmscore.scores(docs, top, flat).select("doc_id", "log_likelihood").collect())
    whole = sorted(
        tuple(r) for r in lmscore.word_scores(docs, top, flat, shares).select("doc_id", "log_likelihood").collect()
    )
    rows.sort(key=lambda r: (r[0], r[1]))
    by_id = {}
    for d, t in rows:
        rare = sum(np.log(words[w] / classes[symbol[w]]) for w in t.encode().split() if symbol[w] > len(top))
        by_id.setdefault(d, []).append(rare)
    for d, rares in by_id.items():
        added = sum(y for i, y in whole if i == d) - sum(x for i, x in plain if i == d)
        assert abs(added - sum(rares)) < 1e-6 * max(1, abs(sum(rares)))
    assert len(whole) == len(plain) == len(rows)


def test_class_ids_are_one_polynomial_without_a_call_for_each_word():
    tokens = lmscore.Tokens(["the", "né"])
    words = [b"the", "né".encode(), b"", b"\xff\x00", b"x" * 5000] + [f"w{i}é{i * i}".encode() for i in range(3000)]

    def plain(word):
        value = 0
        for b in word:
            value = (value * 257 + b + 1) & 0xFFFFFFFF
        return 3 + (value * 2654435761 >> 16 & 0xFFFF) % lmscore.HASHED

    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        found = tokens.numbers(words).tolist()
    finally:
        sys.setprofile(None)
    assert found == [1, 2] + [plain(w) for w in words[2:]]
    assert len(calls) < 100
    assert tokens.numbers([]).tolist() == [] and tokens.hashed([b"a", b"the", b"b", b"a"]) == ([b"a", b"b"], [2, 1])


def test_blocks_of_rows_leave_training_and_scores_alone(monkeypatch):
    found = []
    for rows in (100, 10**6):
        monkeypatch.setattr(lmscore, "ROWS", rows)
        rng = np.random.default_rng(3)
        net = lmscore.Network(lmscore.start(192), 192)
        squares = np.zeros_like(net.flat)
        for n in (lmscore.STEP_TOKENS, 777):
            around, target = rng.integers(0, 192, (4, n)), rng.integers(1, 192, n)
            net.step(around, target, squares)
        found.append((net.flat.copy(), net.log_probabilities(around, target)))
    assert np.allclose(found[0][0], found[1][0], atol=1e-6) and np.allclose(found[0][1], found[1][1], atol=1e-5)


def test_common_words_need_no_join(spark, documents, monkeypatch):
    """Texts' words are joined with their shares only if they are rare in the corpus."""
    docs = documents.select("doc_id", "text")
    odd = "doc_id long, text string"
    docs = docs.unionByName(spark.createDataFrame([(None, "x y\u00a0z x"), (7, None), (7, "")], odd))
    counts = materialised(lmscore.word_counts(docs), spark)
    words = Counter(w for r in docs.collect() for w in (r.text or "").encode().split())
    assert {r.word.encode(): r.n for r in counts.collect()} == words
    top = lmscore.vocabulary(docs, 20)
    shares = materialised(lmscore.word_shares(counts, top), spark)
    flat = lmscore.train(docs, top)
    total = sum(n for w, n in words.items() if w.decode() not in top)
    kept, results = [], []
    for most in (1, 300, lmscore.COMMON):
        monkeypatch.setattr(lmscore, "COMMON", most)
        common = lmscore.common_shares(shares)
        assert set(common) == {w.decode() for w, n in words.items() if w.decode() not in top and n * most >= total}
        kept.append(len(common))
        encoded = lmscore._encoded(docs, top, common).collect()
        assert not any(bytes(w).decode() in common for r in encoded for w in r.words)
        found = lmscore.word_scores(docs, top, flat, shares).collect()
        results.append(sorted((r.doc_id or -1, r.n_tokens, r.log_likelihood) for r in found))
    assert kept[0] == 0 < kept[1] < kept[2]
    for other in results[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in results[0]]
        assert np.allclose([r[2] for r in other], [r[2] for r in results[0]], rtol=1e-9)


def test_counting_tasks_hold_few_words(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "HELD", 3)
    texts = [(" a b\tc\u00a0d  e",), ("a\x0bf a g\r\nh",), (None,), (" \n",), ("a",)]
    found = lmscore.word_counts(spark.createDataFrame(texts, "text string").coalesce(1)).collect()
    assert {r.word: r.n for r in found} == Counter("a b c\u00a0d e a f a g h a".split(" "))


def test_large_logits_are_shifted():
    rng = np.random.default_rng(5)
    around, target = rng.integers(0, 192, (4, 500)), rng.integers(1, 192, 500)
    found = []
    for size in (0.1, 40.0):
        net = lmscore.Network((lmscore.start(192) * size * 10), 192)
        logits = (net.hidden(around) @ net.last).astype(float)
        logits -= logits.max(axis=1)[:, None]
        plain = logits[np.arange(500), target] - np.log(np.exp(logits).sum(axis=1))
        assert np.allclose(net.log_probabilities(around, target), plain, rtol=1e-4, atol=1e-4)
        net.step(around, target, np.zeros_like(net.flat))
        assert np.isfinite(net.flat).all()
        found.append(np.abs(net.last).sum(axis=0).max() < lmscore.SAFE)
    assert found == [True, False]


def test_garbage_in_the_same_class_scores_lower(spark):
    tokens = lmscore.Tokens([])
    kind = tokens.ids("common")[0]
    other = next(w for w in (f"zz{i}" for i in range(9999)) if tokens.ids(w)[0] == kind)
    # More words than symbols, so that both words are only in a class.
    fill = " ".join(f"t{i} t{i} t{i} t{i} t{i} t{i}" for i in range(lmscore.TOP))
    texts = [fill, "a common b", f"a {other} b", "common common"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.log_likelihood for r in lmscore.scored(docs).collect()}
    assert abs(found[1] - found[2] - np.log(3)) < 1e-3


def test_pipeline(spark, documents, edge, empty):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out.cache()
    assert 100 < docs.count() < documents.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    for start in (edge, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert docs.columns[0] == "doc_id"
        docs.collect()
