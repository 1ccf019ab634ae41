"""Bitmaps that spare rows an exchange (native): of bounded size, so they may be broadcast whatever they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap: 262,144 words, about 8 MB where it is broadcast.
BITS = 1 << 24


def bits(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap in which the hashes of a key are set, as rows (word, set): at most BITS / 64, however many keys."""
    place = F.pmod(F.xxhash64(key), F.lit(BITS))
    words = keys.select(F.shiftright(place, 6).alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
    return words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))


def maybe_in(rows: DataFrame, key: Column, bitmap: DataFrame) -> DataFrame:
    """rows whose key may be among those of the bitmap; none that is gets lost. What follows should be an inner join:
    Catalyst would move a semi join below this one."""
    place = F.pmod(F.xxhash64(key), F.lit(BITS))
    marked = rows.withColumn("_place", place).withColumn("word", F.shiftright("_place", 6))
    hit = marked.join(F.broadcast(bitmap), "word").where(F.expr("shiftright(set, int(pmod(_place, 64L))) & 1L = 1L"))
    return hit.drop("word", "_place", "set")
