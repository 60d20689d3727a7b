"""A bit filter of bounded size over 64-bit keys, built by an aggregation and shipped to the tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter: 16 for each key, within these bounds (128 KB and 8 MB).
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 20, 1 << 26


class KeyFilter:
    """Which 64-bit hashes may be in a set: two bits each, no misses. Its size is bounded (``MAX_FILTER_BITS``)."""

    def __init__(self, hashes: DataFrame, column: str):
        spark = hashes.sparkSession
        n = hashes.count()
        self.bits = MIN_FILTER_BITS
        while self.bits < min(16 * n, MAX_FILTER_BITS):
            self.bits *= 2
        bit = F.explode(F.array(*[self._slot(F.col(column), shift) for shift in (0, 32)]))
        words = hashes.select(bit.alias("bit")).groupBy((F.col("bit") / 32).cast("int").alias("word"))
        found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("bits")).toArrow()  # bits/32 rows at most
        table = np.zeros(self.bits // 32, np.uint32)
        table[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
        self.shared = spark.sparkContext.broadcast(table.tobytes())

    def _slot(self, h: Column, shift: int) -> Column:
        return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(self.bits - 1).cast("bigint"))


def maybe(table: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that pass the filter."""
    there = np.arange(len(hashes))
    for shift in (0, 32):
        slot = (hashes[there] >> np.uint64(shift)) & np.uint64(bits - 1)
        there = there[(table[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & 1 == 1]
    return there
