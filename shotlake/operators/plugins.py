"""Pluggable encoders and batch functions, with deterministic offline stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions of the stand-in text encoder.
DIMENSIONS = 16


def encode_text(text: Column) -> Column:
    """A stand-in for a text encoder: words counted by the first hex digit of their MD5. Its ranking means nothing."""
    words = F.filter(F.split(F.lower(text), " "), lambda w: w != "")
    digit = F.transform(words, lambda w: F.substring(F.md5(w.cast("binary")), 1, 1))
    return F.transform(F.split(F.lit("0123456789abcdef"), ""), lambda d: F.size(F.filter(digit, lambda x: x == d)).cast("double"))


_models: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """What load returns, made once a worker process and name."""
    if name not in _models:
        _models[name] = load()
    return _models[name]


def unload(name: str) -> None:
    """Forgets a model of this process."""
    _models.pop(name, None)


def batch_map(df: DataFrame, column: str, make: Callable[..., np.ndarray], model: tuple[str, Callable[[], object]] | None = None) -> DataFrame:
    """df with the vectors of column replaced by make(matrix), Arrow batch by Arrow batch; rows keep their order within a
    partition. model, if given, is a name and what loads it, on first use in a worker process; it is passed to make too."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shotlake.operators import plugins  # the worker's module holds its models

        extra = (plugins.loaded(*model),) if model else ()
        for b in batches:
            if not b.num_rows:
                continue
            matrix = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            made = make(matrix, *extra)
            values = pa.array(list(made), b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([values if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def embed_frames(frames: DataFrame, make: Callable[..., np.ndarray], order: str, step_ms: int = 500, model: tuple[str, Callable[[], object]] | None = None) -> DataFrame:
    """job_id, frame_index, timestamp_ms and embedding made from the frames' vectors: ids count from 0 and times go on by
    step_ms where the frames (job_id, order, embedding) have none of their own."""
    from pyspark.sql import Window

    n = (F.row_number().over(Window.partitionBy("job_id").orderBy(order)) - 1).cast("long")
    own = lambda c, default: F.coalesce(F.col(c), default) if c in frames.columns else default
    rows = frames.withColumn("_n", n)
    rows = rows.select("job_id", own("frame_index", F.col("_n")).alias("frame_index"), own("timestamp_ms", F.col("_n") * step_ms).alias("timestamp_ms"), "embedding")
    return batch_map(rows, "embedding", make, model)
