"""Strided frames and sliding clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotlake.functions.media import frame_at, interval, media_ms
from shotlake.functions.vectors import normalise
from shotlake.sources.tables import ordinals


def stride_sample(frames: DataFrame, fps: Column, target: float, max_frames: int, fallback: bool = True) -> DataFrame:
    """Of frames (job_id, n) every interval-th, at most max_frames a job, with timestamp_ms."""
    step = interval(fps, target, fallback)
    used = F.when(fps > 0, fps).otherwise(30.0)
    kept = frames.where(F.col("n") % step == 0).withColumn("timestamp_ms", media_ms(F.col("n"), used))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("job_id").orderBy("n"))).where(F.col("rank") <= max_frames).drop("rank")


def seek(frames: DataFrame, times: DataFrame, fps: float) -> DataFrame:
    """Frames at the asked times (job_id, ms); misses drop out."""
    asked = times.withColumn("n", frame_at(F.col("ms"), F.lit(fps)))
    return frames.join(asked, ["job_id", "n"])


def clips(frames: DataFrame, window: int = 16, stride: int = 8, mode: str = "seek", max_clips: int | None = None) -> DataFrame:
    """Sliding clips of each job's frames by position: job_id, clip_index, start, length, end_frame; all of them, or the
    first max_clips of a job.

    seek: a clip with fewer than window // 2 real frames is dropped and end_frame is exclusive, perhaps beyond the end;
    batch: none is dropped and end_frame is the last index, inclusive. length counts real frames."""
    jobs = frames.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    out = jobs.select("job_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(stride).cast("long"))).alias("start"))
    out = out.withColumn("length", F.least(F.lit(window), F.col("total") - F.col("start")))
    if mode == "seek":
        out = out.where(F.col("length") >= window // 2).withColumn("end_frame", F.col("start") + window)
    else:
        out = out.withColumn("end_frame", F.least(F.col("start") + window - 1, F.col("total") - 1))
    # only a job's last clips are dropped, so places follow from starts
    out = out.withColumn("clip_index", F.floor(F.col("start") / stride).cast("long"))
    if max_clips is not None:
        out = out.where(F.col("clip_index") < max_clips)
    return out.select("job_id", "clip_index", "start", F.col("length").cast("long").alias("length"), F.col("end_frame").cast("long").alias("end_frame"))


def clip_vectors(frames: DataFrame, window: int = 16, stride: int = 8, mode: str = "seek") -> DataFrame:
    """Clips with the mean of their frames' vectors (the last frame stands for missing ones), L2-normalised: the offline
    stand-in for a clip encoder. Adds start_ms and end_ms of the real frames."""
    placed = ordinals(frames)
    members = clips(frames, window, stride, mode).withColumn("n", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)))
    weight = F.when(F.col("n") == F.col("start") + F.col("length") - 1, window - F.col("length") + 1).otherwise(1).cast("double")
    rows = members.join(placed.select("job_id", "n", "timestamp_ms", "embedding"), ["job_id", "n"]).withColumn("w", weight)
    lists = rows.groupBy("job_id", "clip_index", "start", "end_frame").agg(
        F.sort_array(F.collect_list(F.struct("n", "w", "embedding"))).alias("m"), F.min("timestamp_ms").alias("start_ms"), F.max("timestamp_ms").alias("end_ms")
    )
    zero = F.transform(F.col("m")[0]["embedding"], lambda x: x * 0.0)
    pooled = F.aggregate("m", zero, lambda a, x: F.zip_with(a, x["embedding"], lambda p, q: p + q * x["w"] / window))
    lists = lists.withColumn("pooled", pooled)
    return lists.select("job_id", "clip_index", "start", "end_frame", "start_ms", "end_ms", normalise(F.col("pooled")).alias("embedding"))
