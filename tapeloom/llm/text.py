"""Vectorised words and word-window hashes over Arrow text columns (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers of the rolling hashes, of bytes in a word and of words in a window.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
#: Bytes of text hashed at once: the 64-bit work arrays stay small.
CHUNK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators of words: white space, or everything in ASCII but letters and digits.
SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and len + 1 offsets into them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK, rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of at most ``rows`` rows that hold about ``size`` bytes, or one longer text."""
    data, at = utf8(column)
    row = 0
    while row < len(at) - 1:
        end = min(max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1), row + rows)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Powers:
    """base ** i and base ** -i modulo 2 ** 64, as far as asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, U64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(BYTE_BASE), Powers(WORD_BASE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@dataclass
class Words:
    """Words of several texts: byte spans, 64-bit hashes, and where each text's words begin (rows + 1)."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def spans(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of bytes outside ``separators``; a run ends at the end of its text."""
    n = len(data)
    gap = separators[data]
    opens, closes = np.empty(n, bool), np.empty(n, bool)
    opens[0] = closes[-1] = True
    opens[1:] = gap[:-1]
    closes[:-1] = gap[1:]
    inner = at[(at > 0) & (at < n)]
    opens[inner] = True
    closes[inner - 1] = True
    return np.flatnonzero(opens & ~gap), np.flatnonzero(closes & ~gap) + 1


def words(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    """The words of texts laid end to end: their ``spans`` and hashes."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, np.zeros(0, U64), np.zeros(len(at), np.int64))
    begin, end = spans(data, at, separators)
    up, down = _BYTES(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up, out=sums[1:])
    key = mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * U64(0xA0761D6478BD642F))
    return Words(begin, end, key, np.searchsorted(begin, at))


def window_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word; runs over the end of a text are included and to be masked."""
    n = len(word_hash)
    if n < size:
        return np.zeros(0, U64)
    up, down = _WORDS(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(word_hash * up, out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * down[: n - size + 1])


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    total = int(counts.sum())
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(total) - starts
