"""The provided tables read as frames, vectors, clips and requests; column-pruned, with fixed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotlake.functions.vectors import doubles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame vectors of a job: job_id, frame_index, timestamp_ms, embedding (doubles)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("job_id"), F.col("vec_id").alias("frame_index"), (F.col("vec_id") * 500).alias("timestamp_ms"), doubles(F.col("embedding")).alias("embedding"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's time zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = (days * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identifier, us (microseconds), event_id, event_type, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("identifier"), micros(F.col("ts")).alias("us"), "event_id", "event_type", "value")


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame per job (user) and day: counts of events by eight bins of value, L1-normalised.
    job_id, frame_index (day from 0), hist."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    base = e.select(F.col("user_id").alias("job_id"), (day - 19723).alias("frame_index"), F.least(F.lit(7), F.greatest(F.lit(0), F.floor(F.col("value") / 50))).cast("int").alias("bin"))
    counts = [F.count_if(F.col("bin") == k).cast("double") for k in range(8)]
    hist = F.array(*counts)
    grouped = base.groupBy("job_id", "frame_index").agg(hist.alias("raw"), F.count(F.lit(1)).alias("n"))
    return grouped.select("job_id", "frame_index", F.transform("raw", lambda x: x / (F.col("n") + 1e-7)).alias("hist"))


def ordinals(df: DataFrame, job: str = "job_id", order: str = "frame_index") -> DataFrame:
    """Adds n (position from 0 within the job) and total (frames of the job)."""
    return df.withColumn("n", (F.row_number().over(Window.partitionBy(job).orderBy(order)) - 1).cast("long")).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(job)))
