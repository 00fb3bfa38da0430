"""Elias-Fano coding of growing whole numbers, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BITS = np.array([[i for i in range(8) if b >> i & 1] + [0] * (8 - bin(b).count("1")) for b in range(256)],
                 np.uint8).ravel()
_EACH = U(0x0101010101010101)       # a byte's worth in each of eight bytes
_TOPS = U(0x8080808080808080)
_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays ``head, low, high, rank`` of an increasing sequence of at least 0 numbers.

    The low bits of each number are packed; the rest is a bit vector in which number ``i`` with high part ``h`` sets
    bit ``h + i``; ``rank`` counts the set bits before each 64 of them.
    """
    values = np.asarray(values, np.int64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = min(56, max(0, int(top // max(1, n)).bit_length() - 1))      # a 64-bit window holds 57 from any bit
    packed = np.zeros(n * low // 8 + 9, np.uint8)
    if n and low:
        for at in range(0, n, 1 << 16):     # blocks of whole bytes
            part = values[at:at + (1 << 16)]
            bits = ((part[:, None] >> np.arange(low)) & 1).astype(np.uint8)
            row = np.packbits(bits.ravel(), bitorder="little")
            packed[at * low // 8:at * low // 8 + len(row)] = row
    words = (n + (top >> low)) // 64 + 2
    flags = np.zeros(words * 64, np.uint8)
    flags[(values >> low) + np.arange(n)] = 1
    high = np.packbits(flags, bitorder="little")
    ones = _COUNT[high].reshape(-1, 8).sum(axis=1, dtype=np.int64)
    rank = np.concatenate([[0], np.cumsum(ones)])[:-1]
    return {"head": np.array([n, low], np.int64), "low": packed, "high": high, "rank": rank.astype(np.int64)}


class EliasFano:
    """Reads what ``encode`` wrote; the arrays may be mapped files."""

    def __init__(self, head, low, high, rank):
        self.n, self.low_bits = int(head[0]), int(head[1])
        self.low, self.high, self.rank = low, high, rank
        self.words = high.view("<u8")
        self.zeros = np.arange(len(rank), dtype=np.int64) * 64 - rank
        # A 64-bit window at every byte of the packed low bits.
        self.window = np.ndarray((max(0, len(low) - 7),), "<u8", buffer=low, strides=(1,)) if len(low) > 7 else None

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        got = self.window[at >> 3] >> (at & 7).astype(U)
        return (got & U((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the ``k``-th (from 0) one or zero of the bit vector."""
        counts = self.rank if ones else self.zeros
        word = np.searchsorted(counts, k, "right") - 1
        flags = self.words[word]
        if not ones:
            flags = ~flags
        rest = (k - counts[word]).astype(U)
        # Set bits up to each of the eight bytes, in that byte; the place is in the first byte that exceeds ``rest``.
        sums = flags - ((flags >> U(1)) & (_EACH * U(0x55)))
        sums = (sums & (_EACH * U(0x33))) + ((sums >> U(2)) & (_EACH * U(0x33)))
        sums = ((sums + (sums >> U(4))) & (_EACH * U(0x0F))) * _EACH
        more = ((sums | _TOPS) - (rest + U(1)) * _EACH) & _TOPS
        shift = (U(8) - (((more >> U(7)) * _EACH) >> U(56))) << U(3)
        rest -= ((sums << U(8)) >> shift) & U(255)
        octet = (flags >> shift) & U(255)
        return word * 64 + shift.astype(np.int64) + _BITS[(octet << U(3)) + rest]

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i) << self.low_bits) | self._low(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Places of the numbers ``x``, -1 where they do not occur: successor search in the bucket of the high part."""
        x = np.asarray(x, np.int64)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        h = x >> self.low_bits
        ok = np.flatnonzero((x >= 0) & (h < self.zeros[-1]))
        h, want = h[ok], x[ok] & ((1 << self.low_bits) - 1)
        end = self._select(h, False) - h
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0)
        low, high = start.copy(), end.copy()
        while True:
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            middle = (low[live] + high[live]) >> 1
            less = self._low(middle) < want[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
        hit = low < end
        hit[hit] = self._low(low[hit]) == want[hit]
        out[ok[hit]] = low[hit]
        return out
