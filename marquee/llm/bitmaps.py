"""A bitmap over hashes, of bounded size, that keeps rows without a partner out of a shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB. With very many hashes the map fills up and lets more rows through; what follows it is exact all the same.
MOST_BITS = 1 << 27


def bitmap(hashes: DataFrame, column: str = "h") -> np.ndarray:
    """A bit for each hash, modulo the number of bits: 16 a hash, at most MOST_BITS. The hashes are read twice."""
    bits = min(MOST_BITS, 1 << max(16, int(16 * hashes.count() - 1).bit_length()))
    block = min(bits, 1 << 20)

    def pack(key, group):
        import pandas as pd

        flags = np.zeros(block, dtype=bool)
        flags[group["bit"].to_numpy() % block] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(flags).tobytes()]})

    at = hashes.select(F.pmod(F.col(column), F.lit(bits)).alias("bit")).distinct()
    blocks = at.groupBy(F.floor(F.col("bit") / block).alias("block")).applyInPandas(pack, "block long, bits binary").collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for b, packed in blocks:
        out[b * block // 8 : (b + 1) * block // 8] = np.frombuffer(packed, dtype=np.uint8)
    return out


def contained(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the (unsigned) hashes have their bit set."""
    bit = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (7 - (bit & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
