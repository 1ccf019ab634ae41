"""Clusters of frame vectors and their medoids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotlake.functions.vectors import dot


def centres(labelled: DataFrame, label: str) -> DataFrame:
    """Mean vector of each label: partial sums by (label, position), so nothing gathers a label's vectors."""
    parts = labelled.select(label, F.posexplode("embedding").alias("pos", "x")).groupBy(label, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centre"))


def _squared(a, b):
    d = F.zip_with(a, b, lambda x, y: x - y)
    return dot(d, d)


def medoids(labelled: DataFrame, label: str, id: str = "frame_index") -> DataFrame:
    """label, medoid (member nearest to the mean; least id of ties), members (sorted), size."""
    near = labelled.join(F.broadcast(centres(labelled, label)), label).withColumn("d", F.round(_squared(F.col("embedding"), F.col("centre")), 9))
    return near.groupBy(label).agg(F.min(F.struct("d", id))[id].alias("medoid"), F.count(F.lit(1)).alias("size"))


def assign(vectors: DataFrame, centre_table: DataFrame, id: str = "frame_index") -> DataFrame:
    """id, embedding, cluster: the nearest centre, the least cluster of ties. centre_table has k rows."""
    k = centre_table.agg(F.sort_array(F.collect_list(F.struct("cluster", "centre"))).alias("cs"))
    d = F.transform("cs", lambda c: F.struct(F.round(_squared(F.col("embedding"), c["centre"]), 9).alias("d"), c["cluster"].alias("c")))
    return vectors.crossJoin(F.broadcast(k)).select(id, "embedding", F.array_min(d)["c"].alias("cluster"))


def lloyd(vectors: DataFrame, k: int, steps: int, id: str = "frame_index") -> DataFrame:
    """id, cluster after a fixed number of steps from the k vectors of least id; an empty cluster loses its centre."""
    seeds = vectors.orderBy(id).limit(k).select((F.row_number().over(_order(id)) - 1).alias("cluster"), F.col("embedding").alias("centre"))
    for _ in range(steps):
        placed = assign(vectors, seeds, id)
        seeds = centres(placed, "cluster")
    return assign(vectors, seeds, id).select(id, "cluster")


def _order(id: str):
    from pyspark.sql import Window

    return Window.orderBy(id)  # over k rows


def k_means(vectors: DataFrame, k: int, id: str = "frame_index", seed: int = 42) -> DataFrame:
    """id, embedding, cluster by the library's k-means; one cluster if k is at most 1."""
    if k <= 1:
        return vectors.select(id, "embedding", F.lit(0).alias("cluster"))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = vectors.select(id, "embedding", array_to_vector("embedding").alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(df).transform(df).select(id, "embedding", "cluster")
