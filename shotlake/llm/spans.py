"""Spans of regular expressions in code points, with built-in functions only.

The matches of a pattern and the gaps between them (split by the same pattern) alternate through a text, so the running
sum of their lengths places every match; it is made by blocks of matches, as appending to one long array would copy it
each time. Patterns must not match the empty string. All patterns here run in time linear
in the text: where a plain pattern would start anew at each character of a run, a possessive quantifier or a look behind
gives the same matches once a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

#: Code points of context kept on either side of a span, at most up to the neighbouring match.
CONTEXT = 24
#: Matches that are placed together.
BLOCK = 200


def with_spans(df: DataFrame, name: str, kind: str, pattern: str, keep: Callable[[Column], Column] | None = None, context: bool = False) -> DataFrame:
    """Adds ``name``: array of (kind, start, end, value[, left, right]) of the leftmost non-overlapping matches in the
    column ``text`` whose value passes ``keep``."""
    p = F.lit(pattern)
    df = df.withColumn("_m", F.regexp_extract_all("text", p, F.lit(0)))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    shape = "struct<kind:string,start:int,end:int,value:string" + (",left:string,right:string>" if context else ">")
    m, g = F.col("_m"), F.col("_g")

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.char_length(F.get(g, i))
        end = start + F.char_length(F.get(m, i))
        parts = [F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.get(m, i).alias("value")]
        if context:
            parts += [F.right(F.get(g, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(g, i + 1), F.lit(CONTEXT)).alias("right")]
        return F.struct(end.alias("at"), F.array_append(acc["found"], F.struct(*parts)).alias("found"))

    none = F.array().cast(f"array<{shape}>")

    def block(acc: Column, b: Column) -> Column:
        members = F.sequence(b * BLOCK, F.least(F.size(m), (b + 1) * BLOCK) - 1)
        own = F.aggregate(members, F.struct(acc["at"].alias("at"), none.alias("found")), step)
        # let: the block is placed once, not once for each of the two fields
        return let(own, lambda o: F.struct(o["at"].alias("at"), F.array_append(acc["found"], o["found"]).alias("found")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{shape}>>").alias("found"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int"))
    all_ = F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["found"]))
    df = df.withColumn(name, F.when(F.size(m) > 0, all_).otherwise(none)).drop("_m", "_g")
    return df.withColumn(name, F.filter(name, lambda s: keep(s["value"]))) if keep else df


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]+", "")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda b: (b["start"] < span["end"]) & (b["end"] > span["start"]))
