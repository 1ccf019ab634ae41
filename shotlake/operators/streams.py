"""Encoding in ordered batches, and two streams of which one may fail."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_log = logging.getLogger(__name__)


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """rows with batch and place (from 0) in batches of size, by key in order; a key's last batch may be partial."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("_n", n).withColumns({"batch": F.floor(F.col("_n") / size).cast("long"), "place": (F.col("_n") % size).cast("long")}).drop("_n")


def encode(rows: DataFrame, key: str, order: str, value: str, size: int, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, order, value) with value replaced by make(values of a batch), batch by batch; a batch is one call. Results
    carry their order column, so the caller sorts where order matters. The first error that make raises fails the job,
    after Spark's retries."""
    placed = batches(rows.select(key, order, value), key, order, size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        made = make(pdf[value].to_numpy())
        if len(made) != len(pdf):
            raise ValueError("an encoder must return a value for each input")
        return pd.DataFrame({key: pdf[key], order: pdf[order], value: made, "batch": pdf["batch"]})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return placed.groupBy(key, "batch").applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}, batch long")


def either(needed: DataFrame, optional: Callable[[], DataFrame], path: str) -> tuple[DataFrame, DataFrame | None]:
    """The needed stream and, if it can be computed, the optional one, which is written to path to find out. An optional
    stream that fails is logged and counts as absent; a failure of the needed one is the caller's."""
    try:
        df = optional()
        df.write.parquet(path)
        return needed, needed.sparkSession.read.schema(df.schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        _log.warning("the optional stream failed: %s", str(e)[:200])
        return needed, None
