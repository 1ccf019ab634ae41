"""Exact cosine top-k, ranking, batched queries and two-stream fusion. Ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlake.functions.vectors import EPS, cosine, dot

#: Most query vectors that are broadcast as one matrix (at 1024 dimensions 16 MB), and values of a block of products.
MAX_QUERIES, BLOCK_VALUES = 2_000, 4_000_000


def scored(vectors: DataFrame, query: DataFrame, plain: bool = False) -> DataFrame:
    """vectors with ``score`` against the one row of query (column ``q``), which is broadcast as it is a single vector."""
    kernel = dot if plain else cosine
    return vectors.crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("score", kernel(F.col("embedding"), F.col("q"))).drop("q")


def top_k(vectors: DataFrame, query: DataFrame, k: int, id: str = "frame_index", plain: bool = False) -> DataFrame:
    """The k best (id, score). Only ids and scores are sorted; other columns are joined back by the caller."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return scored(vectors, query, plain).select(id, "score").orderBy(F.desc("score"), id).limit(k)


def rank_all(vectors: DataFrame, query: DataFrame, id: str = "frame_index") -> DataFrame:
    """Every vector of a job with its rank by plain relevance within the job: one sort per job, none over all rows."""
    s = scored(vectors, query, plain=True)
    return s.select("job_id", id, "score", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("score"), id)).alias("rank"))


def _multiplied(vectors: DataFrame, rows: list, k: int, id: str) -> DataFrame:
    """(query_id, id, score) of the k best for each query of a block in each Arrow batch."""
    matrix = np.array([r["q"] for r in rows], float).reshape(len(rows), -1)
    held = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + EPS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, step := max(k, BLOCK_VALUES // len(names))):
                b = whole.slice(at, step)
                ids = b.column(0).to_numpy(zero_copy_only=False)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                s = q @ (v / (np.linalg.norm(v, axis=1, keepdims=True) + EPS)).T
                pick = np.stack([np.lexsort((ids, -row))[:k] for row in s])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, pick.shape[1])), pa.array(ids[pick].ravel()), pa.array(np.take_along_axis(s, pick, 1).ravel())], names=["query_id", id, "score"])

    return vectors.select(F.col(id).cast("long").alias(id), "embedding").mapInArrow(run, f"query_id long, {id} long, score double")


def multi_top_k(vectors: DataFrame, queries: DataFrame, k: int, id: str = "frame_index") -> DataFrame:
    """(query_id, id, score, rank) of the k best for each row of queries (query_id, q): exact, by blocks of MAX_QUERIES
    queries, each broadcast as one matrix. Every Arrow batch keeps its own k best a query, so only k rows a query and batch
    are exchanged; a block of queries is one scan of the vectors and the queries pass the driver block by block."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id)
    out, block = None, []
    asked = queries.select("query_id", "q").where(F.col("q").isNotNull()).toLocalIterator()
    for row in asked:
        block.append(row)
        if len(block) == MAX_QUERIES:
            found = _multiplied(vectors, block, k, id)
            out, block = found if out is None else out.unionByName(found), []
    if block or out is None:
        found = _multiplied(vectors, block, k, id) if block else vectors.sparkSession.createDataFrame([], f"query_id long, {id} long, score double")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def pairs(vectors: DataFrame, id: str = "frame_index", block: int = 1000) -> DataFrame:
    """(job_id, a, b, score) of all pairs a < b within a job. A job's vectors are dealt into blocks by a hash of the id, and
    each pair of blocks is one matrix product, so a task holds two blocks however long the job is."""
    rows = vectors.select("job_id", F.col(id).cast("long").alias("id"), "embedding")
    sizes = rows.groupBy("job_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("n"))
    dealt = rows.join(sizes, "job_id").withColumn("k", F.pmod(F.xxhash64("id"), F.col("n")))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda o: F.struct(F.least(F.col("k"), o).alias("i"), F.greatest(F.col("k"), o).alias("j")))
    dealt = dealt.select("job_id", "id", "embedding", "k", F.explode(met).alias("p")).select("job_id", "id", "embedding", "k", "p.i", "p.j")

    def run(t: pa.Table) -> pa.Table:
        ids, k = t["id"].to_numpy(), t["k"].to_numpy()
        v = np.array(t["embedding"].to_pylist(), float).reshape(len(ids), -1)
        v = v / (np.linalg.norm(v, axis=1, keepdims=True) + EPS)
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        left, right = np.flatnonzero(k == i), np.flatnonzero(k == j)
        s = v[left] @ v[right].T
        a, b = (x.ravel() for x in np.meshgrid(ids[left], ids[right], indexing="ij"))
        on = a < b if i == j else np.ones(len(a), bool)
        one, two = np.minimum(a, b)[on], np.maximum(a, b)[on]
        return pa.table({"job_id": pa.array(np.full(len(one), t["job_id"][0].as_py()), pa.int64()), "a": one, "b": two, "score": s.ravel()[on]})

    return dealt.groupBy("job_id", "i", "j").applyInArrow(run, "job_id long, a long, b long, score double")


def fused(spatial: DataFrame, temporal: DataFrame | None, k: int, alpha: float = 0.5) -> DataFrame:
    """Union of the two top-k lists (id, score), scaled by alpha and 1 - alpha; stream, id, score, best first, at most 2k.
    Spatial scores are scaled even if there is no temporal list."""
    out = spatial.select(F.lit("spatial").alias("stream"), F.col("id"), (F.col("score") * alpha).alias("score"))
    if temporal is not None:
        out = out.unionByName(temporal.select(F.lit("temporal").alias("stream"), F.col("id"), (F.col("score") * (1 - alpha)).alias("score")))
    return out.orderBy(F.desc("score"), "stream", "id").limit(2 * k)


def clip_frames(clips: DataFrame, frames: DataFrame, width: int = 4000) -> DataFrame:
    """Frames whose time lies in a clip [start_ms, end_ms], by job: an equi-join on time buckets of width ms."""
    c = clips.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_ms") / width), F.floor(F.col("end_ms") / width))))
    f = frames.select("job_id", "frame_index", "timestamp_ms", F.floor(F.col("timestamp_ms") / width).alias("bucket"))
    return c.join(f, ["job_id", "bucket"]).where(F.col("timestamp_ms").between(F.col("start_ms"), F.col("end_ms"))).drop("bucket")
