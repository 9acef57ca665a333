"""A filter of 64-bit keys, small enough for every task, that lets pass all keys it was made of."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for a key, and at most so many; a full filter only lets more keys pass.
BITS, MOST_BITS = 16, 1 << 27


class KeyFilter:
    """Lets pass all keys it was made of, and few others."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def key_filter(keys: DataFrame) -> KeyFilter:
    """Filter of ``keys(key)``, combined in Spark; the driver sees its words, a bounded number."""
    size = 1024
    wanted = min(keys.count() * BITS, MOST_BITS)
    while size < wanted:
        size *= 2
    at = F.col("key").bitwiseAND(F.lit(size - 1))
    bit = F.expr("shiftleft(1L, cast(key & 63 as int))")
    found = keys.select(F.shiftright(at, 6).alias("word"), bit.alias("bit"))
    found = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return KeyFilter(bits)
