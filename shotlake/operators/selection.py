"""Key-frame scores and selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotlake.functions.vectors import min_max
from shotlake.operators.shots import gap_filter

#: Weights of position, boundary and query.
WEIGHTS = (0.3, 0.3, 0.2)


def with_position(frames: DataFrame) -> DataFrame:
    """Adds position ts / (last - first + 1) and temporal_score 1 - |position - 0.5| / 2; ts is not offset by the first."""
    w = Window.partitionBy("job_id")
    pos = F.col("timestamp_ms") / (F.max("timestamp_ms").over(w) - F.min("timestamp_ms").over(w) + 1)
    return frames.withColumn("position", pos).withColumn("temporal_score", 1 - 0.5 * F.abs(F.col("position") - 0.5))


def scores(frames: DataFrame, boundaries: DataFrame, relevance: str | None = None) -> DataFrame:
    """job_id, frame_index, score; relevance names a column that is min-max normalised by job, else it counts as 0.5."""
    w = Window.partitionBy("job_id")
    marked = with_position(frames).join(boundaries.select("job_id", "frame_index", F.lit(1.0).alias("b")), ["job_id", "frame_index"], "left")
    q = F.lit(0.5) if relevance is None else F.coalesce(min_max(F.col(relevance), F.min(relevance).over(w), F.max(relevance).over(w)), F.lit(0.5))
    p, b, r = WEIGHTS
    return marked.select("job_id", "frame_index", (p * F.col("temporal_score") + b * F.coalesce("b", F.lit(0.0)) + r * q).alias("score"))


def pick_diverse(e: np.ndarray, n: int) -> list[int]:
    """Max-min picks by cosine distance: first the row of largest mean distance, then the row farthest from those picked;
    the first of ties. All rows in order if there are at most n."""
    if len(e) <= n:
        return list(range(len(e)))
    unit = e / (np.linalg.norm(e, axis=1, keepdims=True) + 1e-7)
    far = lambda k: np.round(1 - unit @ unit[k], 12)
    picked = [int(np.argmax(np.round(1 - unit @ unit.mean(axis=0), 12)))]
    least = far(picked[0])
    while len(picked) < n:
        least[picked] = -np.inf
        picked.append(int(np.argmax(least)))
        least = np.minimum(least, far(picked[-1]))
    return picked


def diverse(frames: DataFrame, n: int | str) -> DataFrame:
    """(job_id, frame_index, pick) of the n most diverse frames of each job; n is a number or a column of the frames.
    A job's vectors meet in one task, beside one distance for each: as many as the sampler keeps of a job."""
    rows = frames.select("job_id", "frame_index", "embedding", (F.lit(n) if isinstance(n, int) else F.col(n)).cast("long").alias("want"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        want = int(pdf["want"].iloc[0])
        picks = pick_diverse(np.array(pdf["embedding"].tolist(), float), want) if want > 0 else []
        return pd.DataFrame({"job_id": pdf["job_id"].iloc[picks].to_numpy(), "frame_index": pdf["frame_index"].iloc[picks].to_numpy(), "pick": np.arange(len(picks))})

    return rows.groupBy("job_id").applyInPandas(run, "job_id long, frame_index long, pick long")


def candidates(frames: DataFrame, boundaries: DataFrame, target: int, max_frames: int) -> DataFrame:
    """job_id, frame_index, source (0 endpoint, 1 boundary), left (frames still wanted, perhaps below 0) before the fill.
    Endpoints are added if a job has two frames; then boundaries in order while fewer than max_frames are chosen."""
    w = Window.partitionBy("job_id")
    f = frames.select("job_id", "frame_index").withColumn("total", F.count(F.lit(1)).over(w)).withColumn("lo", F.min("frame_index").over(w)).withColumn("hi", F.max("frame_index").over(w))
    end = (F.col("total") >= 2) & ((F.col("frame_index") == F.col("lo")) | (F.col("frame_index") == F.col("hi")))
    f = f.join(boundaries.select("job_id", "frame_index", F.lit(True).alias("b")), ["job_id", "frame_index"], "left").withColumn("end", end)
    inner = F.coalesce("b", F.lit(False)) & ~F.col("end")
    order = Window.partitionBy("job_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    f = f.withColumn("inner", inner).withColumn("nth", F.count_if("inner").over(order))
    ends = F.when(F.col("total") >= 2, 2).otherwise(0)
    f = f.withColumn("taken", F.col("inner") & (F.col("nth") + ends <= max_frames))
    f = f.withColumn("left", F.least(F.lit(target), F.col("total")) - ends - F.count_if("taken").over(w))
    return f.where("end OR taken").select("job_id", "frame_index", F.when(F.col("end"), 0).otherwise(1).alias("source"), F.col("left").cast("long").alias("left"))


def select(frames: DataFrame, boundaries: DataFrame, target: int = 15, max_frames: int = 30, gap_ms: int = 2000) -> DataFrame:
    """job_id, frame_index, timestamp_ms of the chosen frames: endpoints, boundaries, a diverse fill, then the gap filter."""
    chosen = candidates(frames, boundaries, target, max_frames)
    w = Window.partitionBy("job_id")
    total = frames.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    left = total.join(chosen.groupBy("job_id").agg(F.first("left").alias("left")), "job_id", "left")
    left = left.select("job_id", F.coalesce("left", F.least(F.lit(target), F.col("total"))).alias("left"))
    rest = frames.join(chosen, ["job_id", "frame_index"], "left_anti").join(left, "job_id").where("left > 0")
    union = chosen.select("job_id", "frame_index").unionByName(diverse(rest, "left").select("job_id", "frame_index")).distinct()
    timed = union.join(frames.select("job_id", "frame_index", F.coalesce("timestamp_ms", F.lit(0)).alias("timestamp_ms")), ["job_id", "frame_index"])
    if gap_ms <= 0:
        return timed.select("job_id", "frame_index", "timestamp_ms")
    return gap_filter(timed, ["job_id"], "timestamp_ms", gap_ms, ["frame_index"]).select("job_id", "frame_index", "timestamp_ms")


def frame_rows(selected: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Chosen frames with their type."""
    b = boundaries.select("job_id", "frame_index", F.lit("scene_boundary").alias("t"))
    return selected.join(b, ["job_id", "frame_index"], "left").select("job_id", "frame_index", F.coalesce("timestamp_ms", F.lit(0)).cast("long").alias("timestamp_ms"), F.coalesce("t", F.lit("regular")).alias("frame_type"))


def from_frames(frames: DataFrame, order: str, target: int = 15, max_frames: int = 30, gap_ms: int = 2000, step_ms: int = 500, boundaries=None) -> DataFrame:
    """select() for frames (job_id, order, embedding) without ids and times: ids count from 0 in order, times go on by
    step_ms. boundaries makes the shot boundaries from such frames."""
    n = (F.row_number().over(Window.partitionBy("job_id").orderBy(order)) - 1).cast("long")
    f = frames.withColumn("_n", n).select("job_id", F.col("_n").alias("frame_index"), (F.col("_n") * step_ms).alias("timestamp_ms"), "embedding")
    return select(f, boundaries(f), target, max_frames, gap_ms)
