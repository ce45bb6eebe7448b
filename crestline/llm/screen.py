"""Bitmaps of fixed size that screen a second scan; joins afterwards decide.

A bitmap is a Bloom filter in blocks of 4 KB: a key's leading bits name a block, three
other parts of it one bit each.  With 16 to 32 bits a key, one in 200 to 1500 of the other
rows passes; a bitmap is 32 MB at most (2^28 bits), which keeps that up to 16 million keys.
Beyond, more rows pass and later joins carry them: results do not change, and the cost
tends to that of a plan without a screen.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BITS = 28
_BLOCK = 15  # 2^15 bits: one row of bitmap_construct_agg
_PARTS = (36, 21, 6)  # where the three places inside a block begin in the key


def bits_for(count: int) -> int:
    return min(MOST_BITS, max(18, (16 * count).bit_length()))


def _block(key: Column | str, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits + _BLOCK).cast("int")


def _places(key: Column | str) -> list[Column]:
    return [F.shiftrightunsigned(key, at).bitwiseAND(F.lit((1 << _BLOCK) - 1)) for at in _PARTS]


def _bitmap_rows(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """(block, m): at most 2^(bits-15) rows of 4 KB."""
    place = keys.select(_block(column, bits).alias("block"), F.explode(F.array(*_places(column))).alias("p"))
    return place.groupBy("block").agg(F.bitmap_construct_agg("p").alias("m"))


def key_bitmap(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bitmap of a bigint column for use in Python; 2^(bits-3) bytes."""
    out = np.zeros((1 << (bits - _BLOCK), 1 << (_BLOCK - 3)), np.uint8)
    for r in _bitmap_rows(keys, column, bits).collect():
        out[r["block"]] = np.frombuffer(bytes(r["m"]), np.uint8)
    return out.ravel()


def hits(bitmap: np.ndarray, bits: int, key: np.ndarray) -> np.ndarray:
    k = key.view(np.uint64)
    base = (k >> np.uint64(64 - bits + _BLOCK)).astype(np.int64) << (_BLOCK - 3)
    out = np.ones(len(k), bool)
    for at in _PARTS:
        p = ((k >> np.uint64(at)) & np.uint64((1 << _BLOCK) - 1)).astype(np.int64)
        out &= ((bitmap[base + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def with_hit(rows: DataFrame, key: Column, keys: DataFrame, column: str, count: int, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether ``key`` may be among the ``count`` keys.

    DataFrame functions only; what is broadcast is the bitmap's rows, 32 MB at most.
    """
    bits = bits_for(count)
    maps = F.broadcast(_bitmap_rows(keys, column, bits).select(F.col("block").alias("_block"), F.col("m").alias("_m")))
    probed = rows.withColumn("_key", key).withColumn("_b", _block("_key", bits))

    def bit(p: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_m"), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
        return F.getbit(byte, (p % 8).cast("int")) == 1

    first, second, third = (bit(p) for p in _places("_key"))
    joined = probed.join(maps, F.col("_b") == F.col("_block"), "left")
    return joined.select(*rows.columns, F.coalesce(first & second & third, F.lit(False)).alias(name))
