"""Spelling variants against all pairs of words, by brute force."""

import collections
import re
import zlib

import pytest

from fileglade.llm import variants


def brute(rows, ratio=5):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                count[word] += 1
    n = {w: c for w, c in count.items() if c >= 5}

    def one_edit(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long_ = sorted((a, b), key=len)
        return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))

    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-n[o], o))
            if n[best] >= ratio * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def test_against_all_pairs(spark):
    base = ["spelling", "variant", "colour", "thêâtre", "abcdef", "aaaaaaaa"]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(base) + " Spelling SPELLING spellling"))
    for i in range(40, 48):
        rows.append((i, "speling varient color colours thêatre abcdeg abcdefg aaaaaaaaa bcdef Zbcdef"))
    rows += [(None, "spelling " * 6), (3, "spelling spelling"), (3, "spelling spelling"), (99, None), (100, ""),
             (101, "x" * 5000 + " " + "y" * 7), (102, "🎉 spellin spellin spellin spellin spellin")]
    rows += [(200 + i, "abcdefgh abcdefgz abcdefgy abcdefgx abcdefhh") for i in range(6)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, word string")
    got = {tuple(r) for r in variants.grouped(frame).collect()}
    want = brute(rows)
    assert any(r[1] for r in want) and got == want


def test_empty_and_argument(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.grouped(empty).count() == 0
    with pytest.raises(ValueError):
        variants.grouped(empty, min_length=3)


def test_only_bigram_counts_are_broadcast(spark, monkeypatch):
    rows = [(i, "spelling spellling spelling spelling spelling spelling spelling") for i in range(8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    plans = []

    def kept(frame, session, write=variants.materialised):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return write(frame, session)

    monkeypatch.setattr(variants, "materialised", kept)
    result = variants.grouped(frame)
    result.collect()
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    joins = [line for text in plans for line in text.splitlines() if "Join" in line]
    sent = [line for line in joins if "BroadcastHashJoin" in line]
    assert len(sent) == 1 and "[gram#" in sent[0]
    assert len(joins) > 5 and all("SortMergeJoin" in line for line in joins if line not in sent)


def test_roots_of_a_chain_and_a_hub(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)]
    hub = [(f"v{i}", "w3") for i in range(300)]
    edges = spark.createDataFrame(chain + hub, "word string, up string")
    got = {tuple(r) for r in variants._roots(edges, spark).collect()}
    assert got == {(word, "w11") for word, _ in chain + hub}
