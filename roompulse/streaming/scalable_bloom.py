"""A Bloom filter that grows with its keys and lies in pages (Almeida et al., 2007; blocked as by Putze et al., 2007).

The filter is a row of slices. Each has twice the pages of the one before and a smaller share of the false positives, so that
their sum stays below the limit however many keys come; a new slice is opened when the last is full. A key's bits of
a slice lie in one page, which is all of that slice that a row reads or writes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

PAGE_BITS = 4096
TIGHTER = 0.8           # false positives of a slice, as a share of those of the one before
LOAD = 0.85             # of what a page takes on average; the rest is for pages that get more
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Growth:
    """Limit of false positives, and the parts into which one filter is cut so that many tasks share it. Neither may change over
    restarts."""

    false_positives: float = 0.03
    parts: int = 256

    @lru_cache(maxsize=256)
    def hashes(self, slice_: int) -> int:
        rate = self.false_positives * (1 - TIGHTER) * TIGHTER ** slice_
        return math.ceil(-math.log2(rate))

    def capacity(self, slice_: int) -> int:
        return int((1 << slice_) * PAGE_BITS * math.log(2) / self.hashes(slice_) * LOAD)


class Pages(Protocol):
    """Where pages are kept: the map state of a stream, or a stand-in."""

    def get(self, slice_: int, page: int) -> bytes | None: ...

    def put(self, slice_: int, page: int, bits: bytes) -> None: ...


def _mixed(h: int) -> int:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & _MASK
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & _MASK
    return h ^ h >> 31


class SlicedBloom:
    """The filter of one part during one call; pages are read when first touched and written by :meth:`save`."""

    def __init__(self, growth: Growth, pages: Pages, slices: int = 1, filled: int = 0, cached: int = 4096):
        self.growth, self.pages, self.slices, self.filled, self.cached = growth, pages, slices, filled, cached
        self.held: dict[tuple[int, int], int] = {}
        self.changed: set[tuple[int, int]] = set()

    def add(self, h: int) -> bool:
        """Add a 64-bit hash; whether it was unknown. A known key may not be taken for new, a new one may for known."""
        for slice_ in range(self.slices - 1, -1, -1):
            at, mask = self._place(h, slice_)
            if self._page(at) & mask == mask:
                return False
        at, mask = self._place(h, self.slices - 1)
        self.held[at] = self._page(at) | mask
        self.changed.add(at)
        self.filled += 1
        if self.filled >= self.growth.capacity(self.slices - 1):
            self.slices, self.filled = self.slices + 1, 0
        return True

    def _place(self, h: int, slice_: int) -> tuple[tuple[int, int], int]:
        g = _mixed((h & _MASK) + (slice_ + 1) * 0x9E3779B97F4A7C15 & _MASK)
        one, two = g & 0xFFFFFFFF, g >> 32 | 1
        mask = 0
        for _ in range(self.growth.hashes(slice_)):
            mask |= 1 << one % PAGE_BITS
            one += two
        return (slice_, _mixed(g) & (1 << slice_) - 1), mask

    def _page(self, at: tuple[int, int]) -> int:
        bits = self.held.get(at)
        if bits is None:
            if len(self.held) >= self.cached:
                self.save()
                self.held.clear()
            bits = self.held[at] = int.from_bytes(self.pages.get(*at) or b"", "little")
        return bits

    def save(self) -> None:
        for at in self.changed:
            self.pages.put(*at, self.held[at].to_bytes(PAGE_BITS // 8, "little"))
        self.changed.clear()

