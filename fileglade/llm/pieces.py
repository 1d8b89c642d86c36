"""SentencePiece BPE encoding and decoding of whole texts by backtracking over longest matches."""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileglade.llm.common import worker_path
from fileglade.llm.memo import Memo

BLANK = "▁"
#: Units in a generation of the memo, and pairs that are remembered before they start anew.
UNITS, PAIRS = 500_000, 500_000


class PieceCodec:
    """Encodes as the sentencepiece library does with a merge-type model, and decodes.

    Only the vocabulary is taken from the library. A text is cut before every run of blanks, which
    no piece crosses. Inside such a unit an Aho-Corasick automaton finds the longest piece at each
    position; the encoder takes it if it is compatible with the piece before, which holds if
    merging both texts anew gives just these two pieces. Otherwise it tries the next shorter piece,
    and when none is left it marks the position as failed in a bit field and steps back. Each
    position fails once at most, so the work is linear in the unit.

    Runs of several blanks have pieces of equal score, for which pairs don't decide; units with
    such a run are merged directly in the library's order (score, then leftmost).
    """

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self._ids: dict[str, int] = {}
        self._scores: dict[str, float] = {}
        self._bytes: dict[int, int] = {}
        self._surface: list[bytes] = []
        self._mergeable = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self._bytes[int(piece[3:5], 16)] = i
                self._surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self._surface.append(b"")
            elif model.is_unknown(i):
                self._surface.append(" ⁇ ".encode())
            else:
                self._surface.append(piece.replace(BLANK, " ").encode())
                if model.is_unused(i):
                    raise ValueError("models with unused pieces are not supported")
                self._ids[piece] = i
                self._scores[piece] = model.get_score(i)
                self._mergeable.add_word(piece, (i, len(piece)))
        if any(BLANK in piece.lstrip(BLANK) for piece in self._ids):
            raise ValueError("pieces with a blank inside are not supported")
        if len(self._bytes) != 256:
            raise ValueError("a model with byte fallback is needed")
        self._mergeable.make_automaton()
        self._text = {i: piece for piece, i in self._ids.items()}
        self._shorter: dict[int, int] = {}
        self._whole: dict[int, bool] = {}
        self._fits: dict[int, bool] = {}
        self._length = [len(self._text.get(i, "")) for i in range(len(self._surface))]
        self._surfaces = np.array(self._surface, object)
        self._units = Memo(lambda unit: self._unit(BLANK + unit), UNITS)

    # ---- merging --------------------------------------------------------------------------------

    def _merge(self, text: str) -> list[str]:
        """Pieces of a text by merging: best score first, leftmost among equals."""
        right = list(range(1, len(text) + 1))
        left = list(range(-1, len(text) - 1))
        part: list[str] = list(text)
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            both = part[i] + part[j]
            if both in self._scores:
                heapq.heappush(agenda, (-self._scores[both], i, j, both))

        for i in range(len(text) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if not part[i] or not part[j] or part[i] + part[j] != both or right[i] != j:
                continue
            part[i], part[j] = both, ""
            right[i] = right[j]
            if right[j] < len(text):
                left[right[j]] = i
                offer(i, right[j])
            if left[i] >= 0:
                offer(left[i], i)
        return [p for p in part if p]

    def _compatible(self, before: int, piece: int) -> bool:
        """Whether merging anew keeps the two pieces side by side; before < 0: the piece alone."""
        if before < 0:
            found = self._whole.get(piece)
            if found is None:
                text = self._text[piece]
                found = self._whole[piece] = self._merge(text) == [text]
            return found
        key = before << 20 | piece
        found = self._fits.get(key)
        if found is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            two = [self._text[before], self._text[piece]]
            found = self._fits[key] = self._merge(two[0] + two[1]) == two
        return found

    def _next_shorter(self, piece: int) -> int:
        """The longest piece that is a proper beginning of a piece, or -1."""
        found = self._shorter.get(piece)
        if found is None:
            text = self._text[piece]
            heads = (self._ids.get(text[:n]) for n in range(len(text) - 1, 0, -1))
            found = self._shorter[piece] = next((h for h in heads if h is not None), -1)
        return found

    def _backtrack(self, text: str, longest: list[int]) -> list[int]:
        """Pieces of a text whose every character is a piece."""
        size = len(text)
        failed = bytearray(size // 8 + 1)
        out: list[int] = []
        at, piece = 0, longest[0]
        lengths, fits, shorter = self._length, self._fits, self._next_shorter
        while at < size:
            before = out[-1] if out else -1
            while piece >= 0:
                end = at + lengths[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fit = fits.get(before << 20 | piece) if out else None
                    if self._compatible(before, piece) if fit is None else fit:
                        break
                piece = shorter(piece)
            if piece >= 0:
                out.append(piece)
                at = end
                if at < size:
                    piece = longest[at]
            elif not out:
                raise ValueError(f"no encoding of {text[:40]!r}")
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= lengths[piece]
        return out

    def _unit(self, unit: str) -> bytes:
        out = array("I")
        if unit.startswith(BLANK * 2):
            for piece in self._merge(unit):
                self._put(out, piece)
            return out.tobytes()
        longest = [-1] * len(unit)
        for end, (piece, length) in self._mergeable.iter(unit):
            longest[end - length + 1] = piece
        if -1 not in longest:
            return array("I", self._backtrack(unit, longest)).tobytes()
        ids, start = self._ids, 0
        for at in range(len(unit) + 1):
            if at == len(unit) or longest[at] < 0 and unit[at] not in ids:
                if at > start:
                    out.extend(self._segment(unit[start:at]))
                if at < len(unit):
                    self._put(out, unit[at])
                start = at + 1
        return out.tobytes()

    def _segment(self, text: str) -> list[int]:
        longest = [-1] * len(text)
        for end, (piece, length) in self._mergeable.iter(text):
            longest[end - length + 1] = piece
        if -1 in longest:  # a character that only occurs inside of longer pieces
            return [i for p in self._merge(text) for i in self._of(p)]
        return self._backtrack(text, longest)

    def _of(self, piece: str) -> list[int]:
        own = self._ids.get(piece)
        return [own] if own is not None else [self._bytes[b] for b in piece.encode()]

    def _put(self, out: array, piece: str) -> None:
        out.extend(self._of(piece))

    # ---- texts ----------------------------------------------------------------------------------

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        begin = array("I", [self.bos]).tobytes() if bos else b""
        end = array("I", [self.eos]).tobytes() if eos else b""
        if not text:
            return begin + end
        text = text.replace(BLANK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            units = [u.replace(" ", BLANK)[1:] for u in re.findall(" +[^ ]*", " " + text)]
        else:
            units = text.split(" ")
        return begin + b"".join(map(self._units.__getitem__, units)) + end

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; broken bytes give U+FFFD each."""
        surface = b"".join(self._surfaces[np.frombuffer(ids, "<u4")].tolist())
        # Only the blank that encoding puts before a text is taken away.
        first = next((i for i in memoryview(ids).cast("I") if self._surface[i]), None)
        if first is not None and self._text.get(first, "").startswith(BLANK):
            surface = surface[1:]
        try:
            return surface.decode()
        except UnicodeDecodeError:
            return _lenient(surface)


def _lenient(data: bytes) -> str:
    """Each byte that belongs to no whole character becomes one U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for width in (1, 2, 3, 4):
            try:
                out.append(data[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.cache
def codec(path: str) -> PieceCodec:
    """One codec for each worker process."""
    return PieceCodec(path)


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


_SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoded(docs: DataFrame, model: str | None = None, digests: bool = False) -> DataFrame:
    """Ids with begin and end ids, and the text they decode to, for each row of (doc_id, text).

    ``digests`` returns SHA-256 of both instead. One pass without a shuffle. A null text is an empty one: only
    the two special ids. Repeated rows and null doc_ids are kept; no rows give no rows.
    """
    path = model or default_path()
    worker_path(docs.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                ids = [own.encode(t if isinstance(t, str) else "") for t in part["text"]]
                texts = [own.decode(i) for i in ids]
                out = {"doc_id": part["doc_id"].astype("Int64"), "n_tokens": [len(i) // 4 for i in ids]}
                if digests:
                    out["ids_sha256"] = [hashlib.sha256(i).hexdigest() for i in ids]
                    out["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                else:
                    out |= {"ids": ids, "decoded": texts}
                yield pd.DataFrame(out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, _DIGESTS if digests else _SCHEMA)
