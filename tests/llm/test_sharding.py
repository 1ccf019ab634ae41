"""Shards by bytes."""

import random
import zlib

from pyspark.sql import functions as F

from shotlake.llm import queries, sharding


def check(df, rows, shards, slack):
    out = df.collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    sizes = [sum(r.size for r in out if r.shard == s) for s in range(shards)]
    for s in range(shards):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert max(sizes) - min(sizes) <= slack, sizes
    return out


def test_sizes(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randrange(200)) for i in range(1500)] + [(None, None), (None, "x"), (3, ""), (7, "dup"), (7, "dup")]
    rows += [(10_000 + i, "one large group of copies " * 4) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit(1))
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    out = check(sharding.shard_by_bytes(df, 8), rows, 8, 2 * 400 + 0.02 * total / 8)
    # equal texts are neighbours: only the large group is cut
    shards = {}
    for r in out:
        shards.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 1 + 8
    assert check(sharding.shard_by_bytes(df.limit(0), 4), [], 4, 0) == []
    few = [(1, "a"), (2, "b" * 50)]
    check(sharding.shard_by_bytes(spark.createDataFrame(few, "doc_id long, text string"), 16), few, 16, 60)


def test_many_splitters(spark):
    """The search in a constant array agrees with the tree of comparisons."""
    rng = random.Random(2)
    cuts = sorted((rng.randrange(-50, 50), rng.randrange(-3, 3)) for _ in range(300))
    df = spark.createDataFrame([(rng.randrange(-60, 60), rng.choice([None, -3, -1, 0, 2])) for _ in range(300)], "h long, i long")
    found = df.select("h", "i", sharding.range_of(F.col("h"), F.col("i"), cuts).alias("k")).collect()
    for r in found:
        assert r.k == sum(c <= (r.h, -(2**63) if r.i is None else r.i) for c in cuts)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    largest = max(len(t.encode()) for _, t in rows) + 1
    check(queries.op6_histogram_shards(spark, sf_dir), rows, 16, 2 * largest)
