"""A blocked Bloom filter in numpy, built by executors in slices and sent to the workers as bytes.

All bits of a key lie in one block of eight 32-bit words, one bit in each, so a probe touches one cache line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
#: Odd multipliers, one for each word of a block.
MULTIPLIERS = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)) & np.uint64(0xFFFFFFFF)
#: The filter never exceeds this; with more keys it passes more rows to the exact join, and stays right.
MAX_BYTES = 64 << 20
SLICES = 64


def blocks_for(keys: int, bits_per_key: int = 16, max_bytes: int = MAX_BYTES) -> int:
    need = max(1, keys * bits_per_key // (32 * WORDS))
    return min(1 << max(6, (need - 1).bit_length()), max_bytes // (4 * WORDS))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint64) % np.uint64(blocks)


def bits_of(h: np.ndarray) -> np.ndarray:
    low = h & np.uint64(0xFFFFFFFF)
    return ((low[:, None] * MULTIPLIERS[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)


def add(words: np.ndarray, h: np.ndarray, first: int, blocks: int) -> None:
    """Set the bits of hashes h in words, which hold the blocks from ``first``."""
    at, bits = block_of(h, blocks).astype(np.int64) - first, bits_of(h)
    for j in range(WORDS):
        np.bitwise_or.at(words[:, j], at, (np.uint64(1) << bits[:, j]).astype(np.uint32))


def contains(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    at, bits = block_of(h, len(words)).astype(np.int64), bits_of(h)
    hit = np.ones(len(h), bool)
    for j in range(WORDS):
        hit &= (words[at, j].astype(np.uint64) >> bits[:, j]) & np.uint64(1) == 1
    return hit


def build(keys: DataFrame, key: str, max_bytes: int = MAX_BYTES, hashed: bool = False) -> np.ndarray:
    """The filter over a column's xxhash64, or over the column if it is ``hashed`` already. Executors fill a slice of blocks each; the driver gets at most ``max_bytes``."""
    hashed = keys.select((F.col(key) if hashed else F.xxhash64(F.col(key))).alias("h"))
    blocks = blocks_for(hashed.count(), max_bytes=max_bytes)
    slices = min(SLICES, blocks)
    per = -(-blocks // slices)

    def fill(batches):
        own: dict[int, np.ndarray] = {}
        for pdf in batches:
            h = pdf["h"].to_numpy(np.int64).view(np.uint64)
            of = (block_of(h, blocks) // np.uint64(per)).astype(np.int64)
            for s in np.unique(of):
                words = own.setdefault(int(s), np.zeros((per, WORDS), np.uint32))
                add(words, h[of == s], int(s) * per, blocks)
        yield pd.DataFrame({"slice": list(own), "words": [w.tobytes() for w in own.values()]})

    block = F.pmod(F.shiftrightunsigned("h", 32), F.lit(blocks))
    dealt = hashed.repartition(slices, F.floor(block / F.lit(per)))
    words = np.zeros((slices * per, WORDS), np.uint32)
    for row in dealt.mapInPandas(fill, "slice long, words binary").collect():
        words[row["slice"] * per : (row["slice"] + 1) * per] |= np.frombuffer(row["words"], np.uint32).reshape(per, WORDS)
    return words[:blocks]


def might_contain(words: np.ndarray, spark, hashed: Column) -> Column:
    """Boolean column: false where the key, given by its xxhash64, is certainly not in the filter."""
    sent = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        return pd.Series(contains(sent.value, h.to_numpy(np.int64).view(np.uint64)))

    return probe(hashed)
