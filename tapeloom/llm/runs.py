"""Ids of many pieces of text at once: each distinct piece is encoded once, all others are gathered with numpy.

Pieces are told apart by two independent 64-bit hashes. Those of up to ``SHORT`` bytes are hashed all together; the rare
longer ones, whose polynomial hashes a made-up text could let collide, by xxhash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash

from tapeloom.llm.text import BYTE_BASE, WORD_BASE, Powers, mixed

U64 = np.uint64
SHORT = 64
_FIRST, _SECOND = Powers(BYTE_BASE), Powers(WORD_BASE)


def piece_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the bytes begin..end of each piece."""
    n, size = len(data), (end - begin).astype(U64)
    out, wide = [], data.astype(U64) + U64(1)
    sums = np.zeros(n + 1, U64)
    for powers in (_FIRST, _SECOND):
        up, down = powers(n + 1)
        np.cumsum(wide * up[:n], out=sums[1:])
        out.append(mixed((sums[end] - sums[begin]) * down[begin] + size * U64(0xA0761D6478BD642F)))
    for k in np.flatnonzero(size > SHORT):
        piece = data[begin[k] : end[k]].tobytes()
        out[0][k], out[1][k] = xxhash.xxh3_64_intdigest(piece), xxhash.xxh3_64_intdigest(piece, 1)
    return out[0], out[1]


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each start and size, one after the other."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class Runs:
    """The ids of pieces, kept from call to call in arrays of at most about ``limit`` bytes.

    ``encode`` gets distinct pieces and returns the ids of each. When the arrays are full, only what the current call
    uses stays.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], dtype: np.dtype, limit: int) -> None:
        self.encode, self.limit = encode, limit
        self.key = self.check = np.zeros(0, U64)
        self.start = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, dtype)

    def bytes(self) -> int:
        return 32 * len(self.key) + self.ids.nbytes

    def _add(self, key: np.ndarray, check: np.ndarray, ids: list[np.ndarray]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start = len(self.ids) + np.cumsum(size) - size
        key, check = np.concatenate([self.key, key]), np.concatenate([self.check, check])
        start, size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        order = np.argsort(key, kind="stable")
        self.key, self.check, self.start, self.size = key[order], check[order], start[order], size[order]
        self.ids = np.concatenate([self.ids, *ids])

    def _keep(self, at: np.ndarray) -> None:
        size = self.size[at]
        self.ids = gathered(self.ids, self.start[at], size)
        self.key, self.check, self.start, self.size = self.key[at], self.check[at], np.cumsum(size) - size, size

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return at, self.key[at] == key if len(self.key) else np.zeros(len(key), bool)

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces in order, and how many each has."""
        if not len(begin):
            return self.ids[:0], self.size[:0]
        key, check = piece_hashes(data, begin, end)
        once, first, which = np.unique(key, return_index=True, return_inverse=True)
        at, known = self._find(once)
        if self.bytes() > self.limit:
            self._keep(at[known])
            at, known = self._find(once)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            pieces = [data[a:b].tobytes() for a, b in zip(begin[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)]
            self._add(once[fresh], check[first[fresh]], self.encode(pieces))
            at, known = self._find(once)
        at = at[which]
        size, start = self.size[at], self.start[at]
        other = np.flatnonzero(self.check[at] != check)
        if len(other):  # another piece has the first hash: encode these one by one
            own = self.encode([data[a:b].tobytes() for a, b in zip(begin[other].tolist(), end[other].tolist(), strict=True)])
            size[other] = [len(x) for x in own]
            start[other] = len(self.ids) + np.cumsum(size[other]) - size[other]
            return gathered(np.concatenate([self.ids, *own]), start, size), size
        return gathered(self.ids, start, size), size
