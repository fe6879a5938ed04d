"""Membership filters of bounded size: a bitmap over the low bits of 64-bit keys.

Spark sets the bits (``bitmap_construct_agg``); the map of at most ``MOST`` bits is sent to the
workers, which drop most keys that are not members before anything is shuffled. It never drops
a member, and what it lets through beyond them an exact step removes. Beyond its size it lets
more through and stays right."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each member, and most bits: 2**28 are 32 MB.
PER_KEY, MOST = 16, 1 << 28


class Bitmap:
    def __init__(self, bits: int, cells: np.ndarray):
        self.mask, self.cells = np.int64(bits - 1), cells

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, column: str) -> Bitmap:
    """The bitmap of a column of 64-bit keys; null keys are no members."""
    keys = keys.where(F.col(column).isNotNull()).select(F.col(column).alias("key"))
    n = keys.count()
    bits = min(MOST, max(1 << 15, 1 << (PER_KEY * n - 1).bit_length() if n else 0))
    place = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    rows = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
    cells = np.zeros(bits >> 3, dtype=np.uint8)
    for r in rows:
        cells[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, dtype=np.uint8)
    return Bitmap(bits, cells)
