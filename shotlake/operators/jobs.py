"""Job states, progress, retries, and keyed table updates."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Legal transitions (fixed values).
EDGES = {
    "pending": ("uploading", "processing", "cancelled"),
    "uploading": ("processing", "failed", "cancelled"),
    "processing": ("extracting", "failed", "cancelled"),
    "extracting": ("analyzing", "failed", "cancelled"),
    "analyzing": ("complete", "failed", "cancelled"),
    "failed": ("pending",),
}
#: Stage and progress milestone of a status (fixed values).
STAGES = {"pending": "upload", "uploading": "upload", "processing": "preprocess", "extracting": "extract", "analyzing": "analyze", "complete": "complete", "failed": "failed", "cancelled": "failed"}
MILESTONES = {"pending": 0.0, "processing": 0.1, "extracting": 0.3, "analyzing": 0.7, "complete": 1.0}
#: Steps of processing a job with the status and progress that each reports (fixed values).
STEPS = (("start", "processing", 0.1), ("preprocess", "processing", 0.2), ("extract", "extracting", 0.3), ("cache", "analyzing", 0.7), ("finish", "complete", 1.0))
TERMINAL = ("complete", "failed", "cancelled")
MAX_RETRIES = 3


def edge_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in EDGES.items() for b in bs], "from_status string, to_status string")


def mapped(values: dict, key: Column, default) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*values.items())])[key], F.lit(default))


def legal(start: Column, to: Column) -> Column:
    """Whether a transition is an edge."""
    tests = [(start == a) & to.isin(*bs) for a, bs in EDGES.items()]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def fold_states(events: DataFrame, order: str = "seq") -> DataFrame:
    """events (job_id, seq, requested) -> job_id, status, progress, retries, rejected after all requests in order.

    requested is a status, or ``retry``. failed is reachable from any state but complete and cancelled; retry only from
    failed, at most MAX_RETRIES times, and resets to pending; cancelled not from an end state; else only edges count.
    A job's requests meet in one array."""
    held = events.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("seq"), "requested"))).alias("s"))
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("retries"), F.lit(0).alias("rejected"))

    def step(a, e):
        s, to = a["status"], e["requested"]
        retry = (to == "retry") & (s == "failed") & (a["retries"] < MAX_RETRIES)
        fail = (to == "failed") & ~s.isin("complete", "cancelled")
        cancel = (to == "cancelled") & ~s.isin(*TERMINAL)
        plain = ~to.isin("failed", "cancelled", "retry", "pending") & legal(s, to)
        ok = retry | fail | cancel | plain
        return F.struct(F.when(retry, "pending").when(ok, to).otherwise(s).alias("status"), (a["retries"] + retry.cast("int")).alias("retries"), (a["rejected"] + (~ok).cast("int")).alias("rejected"))

    out = held.select("job_id", F.aggregate("s", start, step).alias("a"))
    return out.select("job_id", F.col("a.status").alias("status"), F.col("a.retries").cast("long").alias("retries"), F.col("a.rejected").cast("long").alias("rejected"))


def progress_view(jobs: DataFrame) -> DataFrame:
    """job_id, status, stage, progress, done."""
    s = F.col("status")
    return jobs.select("job_id", "status", mapped(STAGES, s, "failed").alias("stage"), mapped(MILESTONES, s, 0.0).alias("progress"), s.isin(*TERMINAL).alias("done"))


def retry_counter(events: DataFrame, order: str = "seq") -> DataFrame:
    """Adds attempt (failures so far of the job) and may_retry."""
    w = Window.partitionBy("job_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("attempt", F.count_if(F.col("requested") == "failed").over(w)).withColumn("may_retry", F.col("attempt") < MAX_RETRIES)


def upsert(table: DataFrame, patch: DataFrame, key: str, columns: list[str], insert: bool = False, order: str | None = None, stamp: Column | None = None) -> DataFrame:
    """Rows of table with the patch's non-null values in columns; with insert also the patch's new keys. Of a key's several
    patch rows the last by order (or by the columns) counts; stamp, if given, becomes updated_at of the rows that change."""
    last = F.max(F.struct(*([order] if order else []), *columns)).alias("_x")
    p = patch.where(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, *[F.col(f"_x.{c}").alias(f"_{c}") for c in columns], F.lit(True).alias("_patched"))
    joined = table.join(p, key, "full" if insert else "left")
    if stamp is not None:
        joined = joined.withColumn("updated_at", F.when(F.col("_patched"), stamp).otherwise(F.col("updated_at")))
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def latest(versions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def live(rows: DataFrame, now: Column, created: str, ttl_seconds: int) -> DataFrame:
    """Rows that have not outlived their time."""
    return rows.where(F.col(created) + F.expr(f"INTERVAL {ttl_seconds} SECONDS") > now)
