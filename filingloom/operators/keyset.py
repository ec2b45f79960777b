"""A run-time filter of keys: rows that surely have none of them are left where they are.

Keys are hashed to bits of ``BITS``; the bits are aggregated into bitmaps of
4 KB by number, at most BITS / 32768 of them, so what is broadcast is bounded by
8 MB whatever the number of keys. A row passes if its key's bit is set; a few
others pass too, so a join follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32768


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def key_bitmaps(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bitmap) of a column of keys."""
    rows = keys.select(F.floor(_bit(key) / BITMAP).alias("bucket"), F.pmod(_bit(key), F.lit(BITMAP)).alias("place"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bitmap"))


def may_have(df: DataFrame, column: str, bitmaps: DataFrame) -> DataFrame:
    """The rows of df whose column may be among the keys."""
    place = F.pmod(_bit(column), F.lit(BITMAP))
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = F.broadcast(bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap")))  # at most BITS / 8 bytes
    met = df.join(told, F.floor(_bit(column) / BITMAP) == F.col("__bucket"))
    return met.filter(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1).select(*df.columns)
