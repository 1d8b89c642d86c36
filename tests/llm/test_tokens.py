"""Encoders, id files and packing against the libraries and by round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fileglade.llm import bytebpe, packing, pieces, repair


def hard_texts(n=1500):
    rng = random.Random(1)
    letters = "aeinrst ▁ \n\téüß日한🎉 .,1203<>abTHE"
    fixed = ["", " ", "  a  b ", "▁▁a", "x" + " " * 37 + "y", "ab" * 3000, "<s> </s> <0x41>", "\x00a", "a\xa0b c"]
    return fixed + ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(n)]


def test_pieces_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    codec = pieces.codec(pieces.default_path())
    for text in hard_texts():
        ids = codec.encode(text)
        expected = model.encode(text, add_bos=True, add_eos=True)
        assert list(memoryview(ids).cast("I")) == expected, text
        assert codec.decode(ids) == model.decode(expected), text


def test_decoding_any_ids():
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    codec = pieces.codec(pieces.default_path())
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(3, 259) for _ in range(8)]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == model.decode(ids)


def test_byte_ids_equal_the_library():
    library = Tokenizer.from_file(bytebpe.default_path())
    own = bytebpe.byte_bpe(bytebpe.default_path())
    special = [
        "<|endoftext|>", "<|endoftext|>a b <|endoftext|>", "a <|endoftext|> b", "word<|endoftext|>word",
        " <|endoftext|>  x\n<|endoftext|>\n", "<|endoftext|><|endoftext|>", "<|endoftext", "é <|endoftext|>é",
    ]
    for text in [*hard_texts(), *special]:
        assert list(memoryview(own.encode(text)).cast("I")) == library.encode(text, add_special_tokens=False).ids


def test_byte_ids_of_many_texts(monkeypatch):
    library = Tokenizer.from_file(bytebpe.default_path())
    rng = random.Random(3)
    words = ["".join(rng.choices("aeinrstéß", k=rng.randint(1, 9))) for _ in range(400)]
    ends = ["", "", ",", ".", "!?", ".\nAb", "'s", "12", " ", "日", "\xa0", "<|endoftext|>", "\x00ÿ"]
    made = [" ".join(rng.choice(words) + rng.choice(ends[: rng.choice((5, 8, 13))]) for _ in range(30)) for _ in range(300)]
    texts = [*made, *hard_texts(300), *made[:50]]
    monkeypatch.setattr(bytebpe, "GROUP", 3000)
    monkeypatch.setattr(bytebpe, "BLOCK", 70)
    monkeypatch.setattr(bytebpe, "CALL", 5)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for memo, ids, kept in ((600_000, 4_000_000, 200_000), (300, 4_000_000, 100), (10_000, 500, 100)):
        monkeypatch.setattr(bytebpe, "MEMO", memo)
        monkeypatch.setattr(bytebpe, "MEMO_IDS", ids)
        monkeypatch.setattr(bytebpe, "KEPT", kept)
        own = bytebpe.ByteBpe(bytebpe.default_path())
        assert [list(memoryview(i).cast("I")) for i in own.encode_all(iter(texts))] == expected
        assert list(own.encode_all([])) == []


def test_long_pieces_do_not_fill_the_memo(monkeypatch):
    monkeypatch.setattr(bytebpe, "GROUP", 1000)
    monkeypatch.setattr(bytebpe, "MEMO_CHARS", 4000)
    own = bytebpe.ByteBpe(bytebpe.default_path())
    texts = [f"row {i}\t" * 40 + "\tend" for i in range(40)] + ["a,b;" * 200 + f"{i} c" for i in range(40)]
    expected = [own._library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(memoryview(i).cast("I")) for i in own.encode_all(texts)] == expected
    assert sum(map(len, own._numbers)) == own._chars <= 4000


def test_new_words_reach_the_model_once_and_together():
    own = bytebpe.ByteBpe(bytebpe.default_path())
    calls = []

    class Counted:
        def __init__(self, model):
            self.model = model

        def tokenize(self, letters):
            calls.append(letters)
            return self.model.tokenize(letters)

    own._model = Counted(own._model)
    numbers = ["".join("aeinrstkl"[int(d)] for d in np.base_repr(i, 9)) for i in range(1000, 2000)]
    texts = [" ".join(["The", *(n + end for n in numbers[a : a + 20])]) for end in ("", ",", ".") for a in range(0, 1000, 20)]
    assert len(list(own.encode_all(texts))) == 150
    assert len(calls) <= 10
    assert sum("".join(calls).count(f"Ġ{n}ÿ") for n in numbers) == len(numbers)


def test_encoded_rows(edge, empty):
    rows = pieces.encoded(edge, digests=True).collect()
    assert len(rows) == edge.count()
    empty_text = next(r for r in rows if r.doc_id == 1)
    assert empty_text.n_tokens == 2 and empty_text.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.encoded(empty).count() == 0


@pytest.mark.parametrize("case", range(12))
def test_grammar_round_trip(case):
    rng = np.random.default_rng(case)
    n = int(rng.integers(1, 4000))
    ids = rng.integers(0, int(rng.integers(1, 12)), n).astype(np.uint32) + 7
    if case % 3 == 0:
        ids[:] = 9
    if case % 3 == 1:
        ids = np.tile(ids[:7], n)[:n]
    cuts = [0, *sorted(rng.integers(0, n, 4)), n]
    docs = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for row in repair.shard_rows(list(range(5)), docs, 0, 0):
        assert (repair.shard_ids(row) == ids).all()
        for _ in range(30):
            a = int(rng.integers(0, n))
            length = int(rng.integers(0, n - a + 1))
            assert (repair.read_range(row, a, length) == ids[a : a + length]).all()
        if case % 3 != 2 and n > 1000:
            assert len(row["symbols"]) < n  # two bytes each, so less than half an id a symbol


def test_id_files(documents, edge, empty, monkeypatch):
    monkeypatch.setattr(repair, "SHARD_IDS", 3000)
    encode = bytebpe.byte_bpe(bytebpe.default_path()).encode
    rows = {r.doc_id: r for r in repair.round_trip(documents).collect()}
    start = 0
    for doc in documents.orderBy("doc_id").collect():
        ids = encode(doc.text) + np.array([2], "<u4").tobytes()
        row = rows[doc.doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        assert bytes(row.ids) == ids
        start += len(ids) // 4
    assert repair.round_trip(edge).count() == edge.count()
    assert repair.round_trip(empty).count() == 0


def test_packing(documents, edge, empty):
    encode = bytebpe.byte_bpe(bytebpe.default_path()).encode
    rows = packing.packed(documents).collect()
    by_doc = {}
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc in documents.collect():
        own = sorted(by_doc[doc.doc_id], key=lambda r: r.start)
        ids = encode(doc.text) + np.array([1], "<u4").tobytes()
        assert b"".join(bytes(r.ids) for r in own) == ids
        assert all(r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)
    order = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in order] == list(range(len(rows)))
    assert [r.length for r in order] == sorted((r.length for r in rows), reverse=True)
    assert packing.packed(edge).filter("doc_id = 1").select("length").first()[0] == 1
    assert packing.packed(empty).count() == 0
    assert sum(packing.binary_lengths(5000)) == 5000
