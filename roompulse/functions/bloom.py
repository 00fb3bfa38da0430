"""Bit positions of a Bloom filter, the same in columns and in Python."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BloomShape:
    """Filter size from the usual formulas; ``buckets`` cuts one filter into independent parts.

    A key belongs to one bucket, so a stream can keep each bucket's bits as a state of its own. A stream cannot
    know its keys beforehand, so ``expected`` must be given: with more keys than that, more new ones are missed.
    """

    expected: int
    false_positives: float = 0.03
    buckets: int = 16

    @property
    def bucket_bits(self) -> int:
        wanted = -self.expected * math.log(self.false_positives) / math.log(2) ** 2
        return math.ceil(wanted / self.buckets)

    @property
    def bits(self) -> int:
        return self.bucket_bits * self.buckets

    @property
    def hashes(self) -> int:
        return max(1, round(self.bits / self.expected * math.log(2)))


def _part(digest: Column, index: int) -> Column:
    return F.conv(F.substring(digest, 8 * index + 1, 8), 16, 10).cast("bigint")


def bucket_column(key: Column, shape: BloomShape) -> Column:
    return F.pmod(_part(F.md5(key), 2), F.lit(shape.buckets))


def bit_columns(key: Column, shape: BloomShape) -> Column:
    """Array of the bits a key owns, numbered through all buckets."""
    digest = F.md5(key)
    base = F.pmod(_part(digest, 2), F.lit(shape.buckets)) * shape.bucket_bits
    return F.array_distinct(F.array(*[
        base + F.pmod(_part(digest, 0) + i * _part(digest, 1), F.lit(shape.bucket_bits))
        for i in range(shape.hashes)]))


def sized_bit_columns(key: Column, keys: Column, false_positives: float) -> Column:
    """Array of the bits a key owns in a filter that is sized for ``keys`` keys."""
    digest = F.md5(key)
    bits = F.ceil(keys * F.lit(-math.log(false_positives) / math.log(2) ** 2))
    return F.array_distinct(F.array(*[
        F.pmod(_part(digest, 0) + i * _part(digest, 1), bits)
        for i in range(max(1, round(-math.log2(false_positives))))]))


def bits_of(key: str, shape: BloomShape) -> list[int]:
    """Bits of a key inside its bucket."""
    digest = hashlib.md5(key.encode("utf-8")).hexdigest()
    one, two = int(digest[:8], 16), int(digest[8:16], 16)
    return sorted({(one + i * two) % shape.bucket_bits for i in range(shape.hashes)})
