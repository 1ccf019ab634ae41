"""Time-ordered aggregation of per-frame answers, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotlake.functions.media import label_mmss, label_ms

#: What an empty list of answers gives.
NOTHING = "No responses to aggregate."
SOURCE_CHARS = 200
#: What stands before and after the time of a first, a middle and a last answer (fixed values).
PHRASES = (("At the beginning (", "): "), ("At ", ": "), ("Finally (", "): "))


def _ordered(responses: DataFrame, *fields: Column | str) -> DataFrame:
    """A job's answers as one array by time: answers a job are as many as its chosen frames."""
    return responses.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("timestamp_ms", "seq", *fields))).alias("r"))


def aggregate(responses: DataFrame, mode: str) -> DataFrame:
    """responses (job_id, timestamp_ms, seq, answer, relevance) -> job_id, answer, confidence, n.

    list: [MM:SS] answer, by line. synthesize: one answer as it is, else each with its time, in the phrases PHRASES.
    Any other mode: joined by blanks."""
    df = _ordered(responses, "answer", "relevance")
    r, n = F.col("r"), F.size("r")
    if mode == "list":
        text = F.array_join(F.transform(r, lambda x: F.concat(F.lit("["), label_mmss(x["timestamp_ms"]), F.lit("] "), x["answer"])), "\n")
    elif mode == "synthesize":
        first, middle, last = (lambda t, p=p: F.concat(F.lit(p[0]), t, F.lit(p[1])) for p in PHRASES)
        phrase = lambda i, t: F.when(i == 0, first(t)).when(i == n - 1, last(t)).otherwise(middle(t))
        text = F.when(n == 1, r[0]["answer"]).otherwise(F.array_join(F.transform(r, lambda x, i: F.concat(phrase(i, label_mmss(x["timestamp_ms"])), x["answer"])), " "))
    else:
        text = F.array_join(F.transform(r, lambda x: x["answer"]), " ")
    mean = F.aggregate(r, F.lit(0.0), lambda a, x: a + x["relevance"]) / n
    return df.select("job_id", F.coalesce(text, F.lit(NOTHING)).alias("answer"), F.coalesce(mean, F.lit(0.0)).alias("confidence"), n.cast("long").alias("n"))


def sources(responses: DataFrame) -> DataFrame:
    """A row per answer with its weight 1/n and its text cut to 200 characters."""
    from pyspark.sql import Window

    n = F.count(F.lit(1)).over(Window.partitionBy("job_id"))
    return responses.select("job_id", "timestamp_ms", "seq", (1.0 / n).alias("weight"), F.substring("answer", 1, SOURCE_CHARS).alias("description"))


def prompt(responses: DataFrame, kind: str, question: str) -> DataFrame:
    """job_id, prompt: analysis lists the frames' times, summary the answers, comparison numbers them against each other."""
    df = _ordered(responses, "answer")
    r = F.col("r")
    if kind == "analysis":
        head, line = f"Question: {question}\nFrames:", lambda x, i: F.concat(F.lit("Frame "), (i + 1).cast("string"), F.lit(" at "), label_ms(x["timestamp_ms"]))
    elif kind == "summary":
        head, line = "Summarise these observations:", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), label_ms(x["timestamp_ms"]), F.lit("] "), x["answer"])
    else:
        head, line = f"Compare with regard to: {question}", lambda x, i: F.concat(F.lit("Item "), (i + 1).cast("string"), F.lit(": "), x["answer"])
    return df.select("job_id", F.concat_ws("\n", F.lit(head), F.array_join(F.transform(r, line), "\n")).alias("prompt"))
