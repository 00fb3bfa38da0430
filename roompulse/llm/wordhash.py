"""Word and n-gram hashes of whole Arrow text columns with numpy; runs inside Spark tasks.

A word's hash is a polynomial over its bytes modulo 2^64, read off one running sum over the column,
then mixed. Nothing is done per word or per document in Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E6C63D0876A9A47          # odd
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK = 1 << 20                     # bytes hashed at a time

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        out = np.full(n, base, U)
        out[0] = 1
        return np.multiply.accumulate(out)
    with np.errstate(over="ignore"):
        return row(_BASE), row(_BASE_INVERSE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end; words end at the latest where their row ends."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = True) -> np.ndarray:
    """One hash per word; works on blocks of bytes that are cut between words."""
    out = np.empty(len(starts), U)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            base = starts[first]
            last = int(np.searchsorted(ends, base + BLOCK, "right"))
            last = max(last, first + 1)
            part = raw[base:ends[last - 1]]
            power, inverse = _powers(max(BLOCK, 1 << int(len(part) - 1).bit_length()))
            code = (_LOWER[part] if lower else part).astype(U)
            code += U(1)
            code *= power[:len(part)]
            total = np.empty(len(part) + 1, U)
            total[0] = 0
            np.cumsum(code, out=total[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            out[first:last] = (total[e] - total[s]) * inverse[s]
            first = last
        return mix(out)


class Words:
    """The words of a text column: ``hash`` of all, ``at`` = where each row's words begin (rows + 1)."""

    def __init__(self, column: pa.Array, lower: bool = True):
        self.raw, offsets = text_bytes(column)
        self.starts, self.ends = word_spans(self.raw, offsets)
        self.hash = word_hashes(self.raw, self.starts, self.ends, lower)
        self.at = np.searchsorted(self.starts, offsets)

    def rows(self):
        """The hashes of each row."""
        for a, b in zip(self.at[:-1], self.at[1:]):
            yield self.hash[a:b]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words of one sequence; a shorter sequence counts as one run."""
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < n:
            total = U(len(h))
            for x in h:
                total = total * U(_BASE) + x
            return mix(np.array([total], U))
        total = np.zeros(len(h) - n + 1, U)
        for j in range(n):
            total = total * U(_BASE) + h[j:len(h) - n + 1 + j]
        return mix(total)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of a hash: ranges of equal width, in order."""
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)
