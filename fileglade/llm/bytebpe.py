"""Byte-level BPE ids of whole texts by the tokenizers library, with a memo of words."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"
#: Pieces, their ids and characters in the memo after a group of texts, and pieces kept when it is full: the most used.
MEMO, MEMO_IDS, MEMO_CHARS, KEPT = 800_000, 5_000_000, 16_000_000, 300_000
#: Characters of texts that are looked up at a time; pieces gathered at a time; pretokens in a call of the model.
GROUP, BLOCK, CALL = 8_000_000, 1 << 17, 256
_PUNCTUATION = ".,!?*#$%&;:"
_LATIN = regex.compile("[\\x00-\\u024f]*")
#: The length of pieces that can't be encoded on their own: a blank is beside another or a text's end.
_UNSAFE = -1


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + n) for n, b in enumerate(others)}


class _Numbers(dict):
    """Numbers keys from 0 on in the order in which they are first looked up; ``fresh`` lists new ones."""

    def __init__(self, keys: list[str]) -> None:
        super().__init__(zip(keys, range(len(keys)), strict=True))
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        self[key] = number = len(self)
        return number


class ByteBpe:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens.

    A single space between two visible characters always starts a pretoken, so such pieces are
    encoded once and remembered. The new pretokens of many texts go to the library's model
    together, and the ids of all pieces are then gathered by the pieces' numbers. Texts with
    other arrangements of blanks, and texts holding the content of an added token
    (``<|endoftext|>`` and the like, which the library matches before any pretoken) go to the
    library whole, as it is; so do single pieces outside the Latin blocks.

    The memo's keys are pieces after a blank, a text's first piece behind one blank, and
    pretokens (as they are, with or without their own blank) behind two.
    """

    def __init__(self, path: str) -> None:
        self._library = Tokenizer.from_file(path)
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values() if t.content]
        self._model = self._library.model
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        letters = _byte_letters()
        self._letters = np.array([ord(letters[b]) for b in range(256)], "<u2")
        # No UTF-8 text has a byte 255, so where no merge has its letter, it keeps pretokens apart.
        vocabulary = self._library.get_vocab(with_added_tokens=False)
        self._mark = vocabulary.get(letters[255])
        self._cuts = self._mark is not None and sum(letters[255] in token for token in vocabulary) == 1
        self._remember([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _remember(self, keys: list[str], starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        self._numbers = _Numbers(keys)
        self._starts, self._lengths, self._ids = starts, lengths, ids
        self._used = np.zeros(len(keys), np.int64)
        self._known, self._held = len(keys), len(ids)  # the arrays have room for more
        self._chars = sum(map(len, keys))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _model_ids(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each pretoken has, and all ids, one pretoken after the other."""
        ids: list[int] = []
        for i in range(0, len(pretokens), CALL):
            raw = b"\xff".join([*map(str.encode, pretokens[i : i + CALL]), b""])
            letters = self._letters[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")
            ids += [token.id for token in self._model.tokenize(letters)]
        found = np.array(ids, np.uint32)
        ends = np.flatnonzero(found == self._mark) if ids else np.zeros(0, np.int64)
        return np.diff(ends, prepend=-1) - 1, np.delete(found, ends)

    def _parts(self, piece: str, first: bool, latin: bool) -> list[str] | None:
        """The keys of the pretokens of a piece that is no word; None if it is unsafe.

        A line's end between two visible characters is a pretoken, and none goes on behind it.
        """
        lines = piece.split("\n")
        if piece.split() != lines:
            return None
        keys = []
        for line in lines:
            word = line.rstrip(_PUNCTUATION)
            bare = first or bool(keys)
            if keys:
                keys.append("  \n")
            if word.isalpha() and (latin or _LATIN.fullmatch(word)):
                keys.append("  " + word if bare else word)
                if len(word) < len(line):
                    keys.append("  " + line[len(word) :])
            else:
                found = self._pattern.findall(line if bare else " " + line)
                keys += [p[1:] if p[0] == " " and p[1:].isalpha() else "  " + p for p in found]
        return keys

    def _learn(self) -> None:
        """Remembers the ids of the keys that were looked up for the first time."""
        fresh, number = self._numbers.fresh, self._numbers.__getitem__
        pretokens, own = [], []
        parts: list[int] = []
        made, counts = [], []
        others, other_ids = [], []
        latin = _LATIN.fullmatch("".join(fresh)) is not None
        for n, key in enumerate(fresh, self._known):  # parts of a piece may be new, too: the list grows
            if key.isalpha() and (latin or _LATIN.fullmatch(key)):
                pretokens.append(" " + key)
                own.append(n)
                continue
            if key[:2] == "  ":
                pretokens.append(key[2:])
                own.append(n)
                continue
            first = key[:1] == " "
            word = key.rstrip(_PUNCTUATION)
            if word.isalpha() and (latin or _LATIN.fullmatch(word)):
                keys = [word, "  " + key[len(word) :]]
            else:
                piece = key[1:] if first else key
                keys = self._parts(piece, first, latin)
                if keys is None:
                    continue
                if not latin and not _LATIN.fullmatch(piece):
                    others.append(n)
                    other_ids.append(self._whole(piece if first else " " + piece))
                    continue
            parts += map(number, keys)
            made.append(n)
            counts.append(len(keys))
        self._numbers.fresh = []
        self._chars += sum(map(len, fresh))
        self._grow(len(fresh))
        self._put(own, *self._model_ids(pretokens))
        if others:
            self._put(others, np.array([len(i) for i in other_ids]), np.concatenate(other_ids))
        if made:
            of = np.array(parts)
            self._put(made, np.add.reduceat(self._lengths[of], np.cumsum(counts) - counts), self._gather(of))
            self._used[of] += 1

    def _grow(self, n: int) -> None:
        self._known += n
        more = max(2 * self._known, 1 << 16) - len(self._lengths)
        if self._known > len(self._lengths):
            self._starts = np.pad(self._starts, (0, more))
            self._lengths = np.pad(self._lengths, (0, more), constant_values=_UNSAFE)
            self._used = np.pad(self._used, (0, more))

    def _put(self, numbers: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
        self._lengths[numbers] = lengths
        self._starts[numbers] = self._held + np.cumsum(lengths) - lengths
        end = self._held + len(ids)
        if end > len(self._ids):
            self._ids = np.pad(self._ids, (0, 2 * end - len(self._ids)))
        self._ids[self._held : end] = ids
        self._held = end

    def _forget(self) -> None:
        """Keeps the most used pieces, as far as their ids and characters take half of the room."""
        kept = np.argsort(-self._used[: self._known], kind="stable")[:KEPT]
        lengths = self._lengths[kept]
        ends = np.cumsum(np.maximum(lengths, 0))
        keys = list(self._numbers)
        chars = np.cumsum([len(keys[i]) for i in kept.tolist()])
        fit = int(min(np.searchsorted(ends, MEMO_IDS // 2, "right"), np.searchsorted(chars, MEMO_CHARS // 2, "right")))
        ids = self._gather(kept[:fit])
        starts = (ends - np.maximum(lengths, 0))[:fit]
        self._remember([keys[i] for i in kept[:fit].tolist()], starts, lengths[:fit], ids)

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        lengths = np.maximum(self._lengths[numbers], 0)
        at = np.repeat(self._starts[numbers] - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return self._ids[at]

    def _looked_up(self, keys: list[str]) -> np.ndarray:
        numbers = np.fromiter(map(self._numbers.__getitem__, keys), np.int64, len(keys))
        if self._numbers.fresh:
            self._learn()
        return numbers

    def _pieced(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts that are not empty, by their pieces: each distinct one is looked up once."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        first = np.asarray(pieces.offsets)
        coded = pieces.values.dictionary_encode()
        places = np.asarray(coded.indices)
        distinct = self._looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        self._used[distinct] += np.bincount(places, minlength=len(distinct))
        numbers = distinct[places]
        numbers[first[:-1]] = self._looked_up([" " + text.partition(" ")[0] for text in texts])
        lengths = self._lengths[numbers]
        ids = np.concatenate([self._gather(numbers[i : i + BLOCK]) for i in range(0, len(numbers), BLOCK)])
        if self._known > MEMO or self._held > MEMO_IDS or self._chars > MEMO_CHARS:
            self._forget()
        unsafe = np.logical_or.reduceat(lengths < 0, first[:-1]).tolist()
        ends = np.cumsum(np.maximum(lengths, 0))[first[1:] - 1].tolist()
        for text, whole, start, end in zip(texts, unsafe, [0, *ends[:-1]], ends, strict=True):
            yield (self._whole(text) if whole else ids[start:end]).astype("<u4").tobytes()

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        cut = [bool(t) and self._cuts and not any(a in t for a in self._added) for t in texts]
        plain = [t for t, c in zip(texts, cut, strict=True) if c]
        pieced = self._pieced(plain) if plain else iter(())
        for text, c in zip(texts, cut, strict=True):
            yield next(pieced) if c else self._whole(text).astype("<u4").tobytes()

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order; some MB of texts are taken at a time."""
        group: list[str] = []
        held = 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= GROUP:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """One encoder for each worker process."""
    return ByteBpe(path)


def default_path() -> str:
    return public_tokenizers.path(DEFAULT)
