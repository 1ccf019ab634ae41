"""Hooks on a stream of job events: callbacks and webhooks as functions for foreachBatch. No network here: what sends is
a callable of the user."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_log = logging.getLogger(__name__)
#: Kinds of events that are told (fixed values), and seconds between the tries of a webhook.
KINDS = ("progress", "complete", "error")
WAITS = (1.0, 2.0)


def event_kind(status: str = "status") -> F.Column:
    return F.when(F.col(status) == "complete", "complete").when(F.col(status).isin("failed", "cancelled"), "error").otherwise("progress")


def callbacks(tell: Callable[[str, dict], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: tell(kind, row) for each event of a micro-batch, in the order of job and seq, on the executors;
    errors of tell are logged and swallowed."""

    def each(rows):
        for r in rows:
            row = r.asDict(recursive=True)
            try:
                tell(row.pop("kind"), row)
            except Exception as e:  # noqa: BLE001
                _log.warning("a callback failed: %s", e)

    def run(batch: DataFrame, _: int) -> None:
        batch.withColumn("kind", event_kind()).repartition("job_id").sortWithinPartitions("job_id", "seq").foreachPartition(each)

    return run


def post(send: Callable[[dict], None], payload: dict, waits: Sequence[float] = WAITS, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Sends a payload, again after each wait if that fails; whether it went through."""
    for wait in (*waits, None):
        try:
            send(payload)
            return True
        except Exception as e:  # noqa: BLE001
            _log.warning("a webhook failed: %s", e)
            if wait is not None:
                sleep(wait)
    return False


def webhooks(send: Callable[[dict], None], waits: Sequence[float] = WAITS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: every event as a payload {event, ...columns}, tried three times."""
    return callbacks(lambda kind, row: post(send, {"event": kind, **row}, waits))
