"""Tables of jobs, clips and queries as Parquet folders, key-value rows with a time to live, and lookups in them.

Appends add files, so several writers do not meet; a table is read as all of its files. Changes of rows are new frames
(``jobs.upsert``, ``jobs.latest``), as plain Parquet has no merge."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Schemas and defaults of the tables (fixed values: names of columns and their defaults).
JOBS = "job_id long, status string, video_path string, filename string, progress double, error string, retry_count int, created_at timestamp_ntz, updated_at timestamp_ntz"
CLIPS = "job_id long, clip_index long, start_frame long, end_frame long, start_ms long, end_ms long, embedding_path string"
HISTORY = "query_id long, job_id long, query_text string, answer string, confidence double, frames_analyzed long, processing_time_ms long"
DEFAULTS = {"status": "pending", "progress": 0.0, "retry_count": 0, "start_ms": 0, "end_ms": 0}
#: Seconds that cached vectors and job hashes live.
WEEK = 7 * 86400


def create(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table at path, made empty if there is none yet."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return read(spark, path, schema)


def read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append(rows: DataFrame, path: str, schema: str, defaults: Mapping[str, object] = DEFAULTS) -> None:
    """Adds rows: columns that they lack, and nulls, get their defaults; a column that the table lacks is refused."""
    empty = rows.sparkSession.createDataFrame([], schema).schema
    if unknown := set(rows.columns) - set(empty.names):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    cols = []
    for f in empty:
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        cols.append((F.coalesce(value, F.lit(defaults[f.name])) if f.name in defaults else value).cast(f.dataType).alias(f.name))
    rows.select(*cols).write.mode("append").parquet(path)


def lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, or none: an equality that reaches the scan."""
    return table.where(F.col(key) == F.lit(value)).limit(1)


def put(table: DataFrame, changes: DataFrame, now_us: Column, ttl_seconds: int | None) -> DataFrame:
    """Key-value rows (key, value, expires_us) with the changes (key, value): of a key's several changes the last by value
    stays; a change without a time to live never expires."""
    expires = F.lit(None).cast("long") if ttl_seconds is None else (now_us + ttl_seconds * 1_000_000).cast("long")
    new = changes.groupBy("key").agg(F.max("value").alias("value")).withColumn("expires_us", expires)
    return table.join(new, "key", "left_anti").select("key", "value", "expires_us").unionByName(new)


def get(table: DataFrame, now_us: Column) -> DataFrame:
    """Key-value rows that have not expired."""
    return table.where(F.col("expires_us").isNull() | (F.col("expires_us") > now_us)).select("key", "value")


def forget(table: DataFrame, jobs: DataFrame, key: str = "key") -> DataFrame:
    """Rows without those of the jobs (job_id): the key job:ID itself and all that begin with job:ID: go."""
    of = F.regexp_extract(F.col(key), r"^job:([0-9]+)(?::|$)", 1).cast("long")
    return table.withColumn("_job", of).join(jobs.select(F.col("job_id").alias("_job")).distinct(), "_job", "left_anti").drop("_job")


def merged(old: Column, new: Column) -> Column:
    """A map with the other's entries over it."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def hashes(fields: DataFrame) -> DataFrame:
    """Rows (key, field, value) -> key, hash: a map of the fields; of repeated fields the greatest value. A hash has as many
    entries as a job has fields."""
    one = fields.groupBy("key", "field").agg(F.max("value").alias("value"))
    return one.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("hash"))


def with_cached_vectors(clips: DataFrame, cache: DataFrame) -> DataFrame:
    """Clips (embedding_path, ...) with the vector of the cache (key, value: JSON); missing and corrupt ones drop out."""
    from shotlake.functions.vectors import from_json

    found = clips.join(cache.select(F.col("key").alias("embedding_path"), from_json(F.col("value")).alias("embedding")), "embedding_path")
    return found.where(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))


def numbered(rows: DataFrame, order: str, name: str = "id", start: int = 0) -> DataFrame:
    """rows with consecutive numbers from start in the order of a column: sorted by range, counted by partition (one small
    row each), so no single task numbers all."""
    ranged = rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(order)
    local = ranged.withColumn("_n", F.row_number().over(w))
    counts = local.groupBy("_p").agg(F.max("_n").alias("_c"), F.min(order).alias("_o"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn(name, (F.col("_b") + F.col("_n") - 1 + start).cast("long")).drop("_p", "_n", "_b")


def blobs(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """path (below root), bytes of the files in the folder prefix and below; hidden ones are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/{prefix}".rstrip("/"))
    bare = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return files.select(F.substring_index("path", f"{bare}/", -1).alias("path"), F.col("length").alias("bytes"))
