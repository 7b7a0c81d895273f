"""A bitmap of hashed keys, with 16 bits or more for each: what it lets pass is checked exactly afterwards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables

LEAST, MOST = 1 << 20, 1 << 30
_BUCKET = 32768


def size_for(keys: int) -> int:
    """Bits for so many keys: 128 KB of them at least and 128 MB at most. Only past 10^8 keys more than one in ten others passes, and results are exact then too."""
    return min(MOST, max(LEAST, 1 << (16 * keys).bit_length()))


def sieve(df: DataFrame, key: str) -> np.ndarray:
    """The bits, packed, for a long column of a written table."""
    bits = size_for(df.count())
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in _buckets(df, key, bits).collect():
        at = (row["bucket"] - 1) * _BUCKET // 8
        out[at : at + _BUCKET // 8] = np.frombuffer(row["bits"], dtype=np.uint8)[: len(out) - at]
    return out


def _buckets(df: DataFrame, key: str, bits: int) -> DataFrame:
    slot = slot_of(F.col(key), bits) + 1
    places = df.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    return places.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def parted(df: DataFrame, key: str, keys: DataFrame, tables: Tables, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose long ``key`` may be among those of ``keys``, a written table, and the rows whose key is not; by the bitmap, which is broadcast, without Python."""
    bits = size_for(keys.count())
    buckets = tables.save(_buckets(keys, key, bits), name)
    slot = slot_of(F.col(key), bits)
    own = df.withColumns({"__bucket": F.shiftright(slot, 15) + 1, "__bit": slot.bitwiseAND(F.lit(_BUCKET - 1)).cast("int")})
    own = own.join(F.broadcast(buckets.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))), "__bucket", "left")
    byte = "cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)"
    may = F.coalesce(F.expr(f"getbit({byte}, __bit % 8) = 1"), F.lit(False))
    return own.filter(may).select(*df.columns), own.filter(~may).select(*df.columns)


def slot_of(key: Column, bits: int) -> Column:
    return key.bitwiseAND(F.lit(bits - 1))


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the int64 keys the bitmap holds, with false positives and no false negatives."""
    slot = keys.astype(np.int64) & (len(bitmap) * 8 - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
