"""Rules, lines and fingerprints against plain Python."""

import hashlib
import re
from collections import Counter

from fileglade.llm import fingerprints, lines, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    visible = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        len(visible) - len(set(visible)), len(hit),
    )


def test_measures(documents, edge, empty):
    for docs in (documents, edge):
        texts = Counter(measured(r.text) for r in docs.collect())
        rows = quality.judged(docs.select("doc_id", "text", "lang", "source")).collect()
        assert Counter(tuple(r[m] for m in quality.MEASURES) for r in rows) == texts
        for r in rows:
            assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality.judged(empty).count() == 0
    assert quality.kept_documents(edge).columns == edge.columns


def test_outliers_of_a_group_go(spark, documents):
    good = documents.filter("length(text) > 200").select("doc_id", "text", "lang", "source")
    junk = spark.createDataFrame(
        [(5000, " ".join(f"w{i}*** #{i}" for i in range(40)), "en", "s0")], good.schema
    )
    rows = quality.judged(good.unionByName(junk)).collect()
    assert {r.doc_id for r in rows if not r.kept and not r.base_failed} == {5000}


def test_much_junk_does_not_raise_its_own_limit(spark):
    rows = []
    for share in (3, 7):  # tenths of a source that are junk
        for i in range(100):
            words = [f"word{i}x{k}" for k in range(60)]
            bad = i % 10 < share
            symbols = " ".join(w + "***" * bad for w in words)
            doubled = "\n".join(w + "\na\nb\nc\nd" * bad for w in words)  # no five words repeat
            for kind, text in (("symbols", symbols), ("lines", doubled)):
                rows.append((len(rows), text, "en", f"{kind}{share}", bad))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, bad boolean")
    for r in quality.judged(docs).collect():
        assert r.kept != r.bad and not r.base_failed


def test_sketches_merge(documents):
    found = quality.measure(documents)
    whole = quality.sketches(found)
    halves = [quality.sketches(found.filter(f"doc_id % 2 = {i}")) for i in (0, 1)]
    keys = ["lang", "source"]
    merged = quality.merge(halves[0].unionByName(halves[1]), keys).collect()
    assert {tuple(r) for r in merged} == {tuple(r) for r in quality.merge(whole, keys).collect()}


def test_lines(documents, edge, empty):
    rows = documents.collect()
    pages = Counter(r.source for r in rows)
    seen = Counter((r.source, x) for r in rows for x in {x for x in r.text.split("\n") if x.strip()})
    out = {r.doc_id: r for r in lines.without_boilerplate(documents).collect()}
    dropped = 0
    for r in rows:
        keep = [x for x in r.text.split("\n") if not x.strip() or seen[r.source, x] < max(5, 0.1 * pages[r.source])]
        assert out[r.doc_id].text == "\n".join(keep)
        assert out[r.doc_id].n_dropped == len(r.text.split("\n")) - len(keep)
        dropped += out[r.doc_id].n_dropped
    assert dropped > 50
    assert lines.without_boilerplate(edge).count() == edge.count()
    assert lines.without_boilerplate(edge).filter("doc_id = 1").first().text is None
    assert lines.without_boilerplate(empty).count() == 0


def test_lines_of_small_hosts(spark):
    rows = [(i, f"own line {i}\nfooter", "ten") for i in range(10)]
    rows += [(20 + i, f"own line {i}\nfooter", "four") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in lines.without_boilerplate(docs).collect():
        assert r.n_dropped == (r.source == "ten")
        assert r.text == f"own line {r.doc_id % 20}" + "\nfooter" * (r.source == "four")


def test_edited_texts_and_likeness(documents, edge, empty):
    texts = [(r.doc_id, r.text) for r in documents.orderBy("doc_id").collect()]
    rows = {r.doc_id: r for r in fingerprints.edited_pairs(documents).collect()}
    prints = {}
    closer = 0
    for i, (doc, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        closer += r.near_edited > r.near_next
    assert closer > 0.8 * len(texts)
    odd = fingerprints.edited_pairs(edge).collect()
    assert len(odd) == edge.count() and all(0 <= r.near_edited <= 1 for r in odd)
    assert fingerprints.edited_pairs(empty).count() == 0


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(moved))], "doc_id long, text string")
    sizes = {r.doc_id: r.fingerprint for r in fingerprints.signatures(frame).collect()}
    same = sum(sizes[1][i : i + 8] == sizes[2][i : i + 8] for i in range(0, 512, 8))
    assert 20 < same < 60  # nearly the same 5-mers, but pairs from both halves changed their order
