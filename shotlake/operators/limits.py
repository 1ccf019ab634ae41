"""Sliding-window rate limits over a request stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limit(requests: DataFrame, limit: int, window_us: int) -> DataFrame:
    """For each distinct (identifier, us): requests in (us - window, us], whether allowed, what remains, reset second.
    Equal stamps of an identifier count once, rejected calls still count."""
    w = Window.partitionBy("identifier").orderBy("us").rangeBetween(-(window_us - 1), 0)
    r = requests.select("identifier", "us").distinct().withColumn("n", F.count(F.lit(1)).over(w))
    return r.select("identifier", "us", "n", (F.col("n") <= limit).alias("allowed"), F.greatest(F.lit(0), limit - F.col("n")).alias("remaining"), F.floor((F.col("us") + window_us) / 1000000).alias("reset_s"))


def rate_info(requests: DataFrame, limit: int, window_us: int) -> DataFrame:
    """As rate_limit for readers: the window is closed on both sides and nothing is inserted."""
    w = Window.partitionBy("identifier").orderBy("us").rangeBetween(-window_us, 0)
    r = requests.select("identifier", "us").distinct().withColumn("n", F.count(F.lit(1)).over(w))
    return r.select("identifier", "us", "n", F.greatest(F.lit(0), limit - F.col("n")).alias("remaining"))
