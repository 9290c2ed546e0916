"""A Bloom filter of fixed size over ids, so that a later pass can skip rows before touching their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import mix

#: 2^24 bits, 2 MB whatever the data; more ids only make it let more rows through.
BITS = 24
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))


def _places(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for seed in _SEEDS:
        yield (mix(ids.astype(np.int64).view(np.uint64) ^ seed) >> np.uint64(64 - bits)).astype(np.int64)


def build(ids: DataFrame, col: str, bits: int = BITS) -> bytes:
    """Compressed bitmap of 2^bits: OR of one partial bitmap per group of partitions."""

    def partial(batches):
        bitmap = np.zeros(1 << bits, bool)
        some = False
        for frame in batches:
            some = some or len(frame) > 0
            for at in _places(frame[col].to_numpy(), bits):
                bitmap[at] = True
        if some:
            yield pd.DataFrame({"part": [0], "bitmap": [zstandard.compress(np.packbits(bitmap).tobytes())]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << bits) // 8, np.uint8)
        for blob in frame["bitmap"]:
            total |= np.frombuffer(zstandard.decompress(blob), np.uint8)
        return pd.DataFrame({"part": [0], "bitmap": [zstandard.compress(total.tobytes())]})

    parts = ids.select(F.col(col).cast("long").alias(col)).filter(F.col(col).isNotNull()).mapInPandas(partial, "part int, bitmap binary")
    spread = parts.withColumn("part", F.spark_partition_id() % 64).groupBy("part").applyInPandas(merge, "part int, bitmap binary")
    rows = spread.collect()  # at most 64 bitmaps
    total = np.zeros((1 << bits) // 8, np.uint8)
    for row in rows:
        total |= np.frombuffer(zstandard.decompress(bytes(row["bitmap"])), np.uint8)
    return zstandard.compress(total.tobytes())


class Filter:
    def __init__(self, packed: bytes):
        self.bitmap = np.unpackbits(np.frombuffer(zstandard.decompress(packed), np.uint8)).astype(bool)

    def may_have(self, ids: np.ndarray) -> np.ndarray:
        out = np.ones(len(ids), bool)
        for at in _places(ids, len(self.bitmap).bit_length() - 1):
            out &= self.bitmap[at]
        return out
