"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean, fresh_path, mark, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b), of any comparable type -> (v, root) for each vertex of an edge between different vertices other than
    the root itself: root is the least vertex of its component. Each round writes its edges to the shared folder; rounds
    grow with the logarithm of the longest path. A vertex with many edges is a skewed join key, which AQE splits."""
    a, b = F.col("a"), F.col("b")
    begun, spark = mark(), edges.sparkSession
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), name)
    count = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
    before = count(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        own = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(own, "hi")
        small = small.select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        path = fresh_path(spark, name)
        now = written(small.where(F.col("hi") != F.col("lo")).distinct(), name, path)
        clean(spark, begun, path)  # the rounds before
        after = count(now)
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("v"), F.col("lo").alias("root"))
