"""Stateful streams: frame-at-a-time shot detection and the rate limiter, as functions of a streaming DataFrame."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shotlake.operators import store
from shotlake.session import shared_folder

#: Milliseconds behind the watermark after which the state of a silent job is removed: a week.
IDLE_MS = 7 * 86_400_000


def _timed(rows: DataFrame, time: str | None, idle_ms: int) -> tuple[DataFrame, str]:
    """rows with a watermark on the column time, and the timeout that goes with it. Without time state is never removed."""
    if time is None:
        return rows.withColumn("_ms", F.lit(None).cast("long")), GroupStateTimeout.NoTimeout
    rows = rows.withWatermark(time, f"{idle_ms} milliseconds")
    return rows.withColumn("_ms", F.unix_millis(F.col(time))), GroupStateTimeout.EventTimeTimeout


def _expire(state: GroupState, pdf: pd.DataFrame, idle_ms: int) -> None:
    """State is removed when the watermark passes idle_ms behind the latest row."""
    if (last := pdf["_ms"].max()) == last:
        state.setTimeoutTimestamp(max(int(last), state.getCurrentWatermarkMs()) + idle_ms)


def stream_shots(frames: DataFrame, threshold: float = 0.3, time: str | None = None, idle_ms: int = IDLE_MS) -> DataFrame:
    """Boundaries of a stream of (job_id, frame_index, hist): state is the previous histogram. The first frame of a job
    gives nothing; the threshold is fixed and there is no least scene length, other than in batch. Frames of a job
    must arrive in order; those of one micro-batch are sorted. With a time column a job without frames for idle_ms behind the watermark begins
    anew, and frames that late are dropped."""
    frames, timeout = _timed(frames, time, idle_ms)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("frame_index")
        last = np.array(state.get[0]) if state.exists else None
        rows = []
        for index, hist in zip(pdf["frame_index"], pdf["hist"], strict=True):
            h = np.asarray(hist, float)
            if last is not None and (d := float((((h - last) ** 2) / (h + last + 1e-10)).sum() / 2)) > threshold:
                rows.append((key[0], int(index), d, min(1.0, d / (3 * threshold))))
            last = h
        state.update((last.tolist(),))
        _expire(state, pdf, idle_ms)
        yield pd.DataFrame(rows, columns=["job_id", "frame_index", "distance", "confidence"])

    return frames.groupBy("job_id").applyInPandasWithState(run, "job_id long, frame_index long, distance double, confidence double", "last array<double>", "append", timeout)


def stream_limit(requests: DataFrame, limit: int, window_us: int) -> DataFrame:
    """Verdicts on a stream of (identifier, us): state is the stamps of about the last window, sorted. Equal stamps count
    once. A stamp that comes late counts those of the window before it, not those after it; stamps more than two windows
    behind the latest are forgotten. The state of an identifier that is silent for two windows behind the watermark goes, and
    stamps that late are dropped."""
    idle_ms = max(1, 2 * window_us // 1000)
    requests, timeout = _timed(requests.withColumn("_ts", F.timestamp_micros("us")), "_ts", idle_ms)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = sorted(state.get[0]) if state.exists else []
        rows = []
        pdf = pd.concat(list(batches))
        for us in sorted(set(pdf["us"].tolist())):
            if (at := bisect_left(held, us)) == len(held) or held[at] != us:
                held.insert(at, us)
            n = at + 1 - bisect_right(held, us - window_us)
            rows.append((key[0], us, n, n <= limit))
        state.update((held[bisect_right(held, held[-1] - 2 * window_us) :],))
        _expire(state, pdf, idle_ms)
        yield pd.DataFrame(rows, columns=["identifier", "us", "n", "allowed"])

    return requests.groupBy("identifier").applyInPandasWithState(run, "identifier long, us long, n long, allowed boolean", "held array<long>", "append", timeout)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives for the input there is now, as a Parquet table in the shared folder, where its state stands
    too; no row passes the driver."""
    spark: SparkSession = stream.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return store.create(spark, path, stream.schema)
