"""Deep-shallow sorting of equally long byte strings.

Multikey quicksort orders strings by eight bytes at a time down to a shallow depth. Strings still
tied there, with long common prefixes, are ordered by a blind trie for each group of ties: a new
string walks down by the branching bytes alone, is compared once with the leaf it reaches, and is
inserted where that comparison says.
"""

from __future__ import annotations

import numpy as np

#: Segments up to this size are ordered by all their words at once.
SMALL = 2048


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """An order of the rows of a matrix of big-endian words."""
    n, width = words.shape
    order = np.arange(n)
    work = [(0, n, 0)]
    while work:
        lo, hi, depth = work.pop()
        if hi - lo < 2 or depth == width:
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            keys = [words[part, d] for d in range(width - 1, depth - 1, -1)]
            order[lo:hi] = part[np.lexsort(keys)]
            continue
        key = words[part, depth]
        pivot = np.sort(key[:: max(1, len(key) // 33)])[16 if len(key) >= 33 else 0]
        less, more = key < pivot, key > pivot
        a, b = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate([part[less], part[~less & ~more], part[more]])
        work += [(lo, lo + a, depth), (lo + a, hi - b, depth + 1), (hi - b, hi, depth)]
    return order


class BlindTrie:
    """Orders strings of one length that share their first bytes."""

    def __init__(self, length: int) -> None:
        self._bits = 8 * length
        self._length = length
        self._texts: list[bytes] = []
        self._numbers: list[int] = []
        self._equal: list[list[int]] = []
        self._root: list | int | None = None

    def add(self, item: int, text: bytes) -> None:
        node = self._root
        if node is None:
            self._root = self._leaf(item, text)
            return
        while not isinstance(node, int):
            children = node[1]
            child = children.get(text[node[0]])
            node = next(iter(children.values())) if child is None else child
        if self._texts[node] == text:
            self._equal[node].append(item)
            return
        number = int.from_bytes(text)
        common = (self._bits - (self._numbers[node] ^ number).bit_length()) // 8
        other = self._texts[node][common]
        parent, at = None, self._root
        while not isinstance(at, int) and at[0] < common:
            parent, at = at, at[1][text[at[0]]]
        leaf = self._leaf(item, text)
        if not isinstance(at, int) and at[0] == common:
            at[1][text[common]] = leaf
            return
        branch = [common, {other: at, text[common]: leaf}]
        if parent is None:
            self._root = branch
        else:
            parent[1][text[parent[0]]] = branch

    def _leaf(self, item: int, text: bytes) -> int:
        self._texts.append(text)
        self._numbers.append(int.from_bytes(text))
        self._equal.append([item])
        return len(self._texts) - 1

    def ordered(self) -> tuple[list[int], list[int]]:
        """Items in order, and the common prefix of each with the one before (the first: 0)."""
        items: list[int] = []
        common: list[int] = []
        work = [(self._root, 0)]
        while work:
            node, depth = work.pop()
            if isinstance(node, int):
                own = self._equal[node]
                items += own
                common += [depth, *[self._length] * (len(own) - 1)]
                continue
            children = sorted(node[1].items(), reverse=True)
            work += [(child, node[0]) for _, child in children[:-1]]
            work.append((children[-1][1], depth))
        return items, common


def deep_shallow_sort(texts: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of a matrix of bytes, and the common prefix of each with the one before.

    ``shallow`` is a multiple of 8. The first common prefix is 0.
    """
    n, length = texts.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.zeros((n, shallow), np.uint8)
    head[:, : min(shallow, length)] = texts[:, :shallow]
    words = head.view(">u8").astype(np.uint64)
    order = multikey_quicksort(words)
    sorted_head = head[order]
    differs = sorted_head[1:] != sorted_head[:-1]
    tied = ~differs.any(axis=1)
    common = np.zeros(n, np.int64)
    common[1:] = np.where(tied, min(shallow, length), differs.argmax(axis=1))
    if length <= shallow:
        return order, common
    starts = np.flatnonzero(np.concatenate([[True], ~tied]))
    ends = np.append(starts[1:], n)
    flat = np.ascontiguousarray(texts[order]).tobytes()
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a < 2:
            continue
        trie = BlindTrie(length)
        for i in range(a, b):
            trie.add(i, flat[i * length : (i + 1) * length])
        items, prefix = trie.ordered()
        order[a:b] = order[items]
        common[a + 1 : b] = prefix[1:]
    return order, common
