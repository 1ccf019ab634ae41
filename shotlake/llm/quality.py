"""Quality rules as a short-circuit cascade (native).

A rule rejects a text by metrics of it, such as its repeated words. On a bounded sample the cascade measures what each
rule costs a row, metrics included, and how many rows it rejects, orders the rules by rejections per second, and tests
every document in that order. A metric is computed when the first rule that needs it comes up, and only for rows that no
earlier rule has rejected, so what stands late in the order costs nothing for them. The order decides the work done and
which rule is named, never which documents stay. ``filled`` computes what the cascade left out, for callers that want
every metric of every row.

The sample is the rows of the SAMPLE_ROWS least hashes of the id, of each text at most SAMPLE_CHARS characters; it is
read where it lies, repeated SAMPLE_TIMES so that rules take longer than a job's start, and never reaches the driver.

Defined results: a null text counts as empty, has no words and is rejected by ``few_words``; repeated rows are judged
one by one; an empty table gives an empty table; columns of the input keep their names and values, except that an
input column named ``rejected_by`` is replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import space_words, text_or_empty

#: Rows of the sample that orders the rules, characters of a text in it, and how often it is repeated.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_TIMES = 256, 20_000, 12
#: Words of the windows of ``n_repeat_words``.
REPEAT_WINDOW = 5

#: Limits of the default rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOLS_PER_WORD = 1.0
MAX_DUP_LINE_PERCENT = 50
MIN_MEAN_WORD, MAX_MEAN_WORD = 1.5, 25.0


class Rule(NamedTuple):
    """name, the metrics that it needs, and its condition on them (and on ``words``) that rejects a row."""

    name: str
    metrics: tuple[str, ...] = ()
    rejects: Callable[[], Column] | None = None


def n_symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def _repeat_words(df: DataFrame, alive: Column) -> DataFrame:
    """Words inside windows of five words that the text holds twice or more.

    Hashes of the windows show most texts to have no repeat at all. Of the others the hashes are sorted with their places,
    and neighbours of one hash are compared word by word; the words that they cover are counted from their sorted places."""
    w, k = F.col("words"), REPEAT_WINDOW
    at = lambda: F.sequence(F.lit(0), F.size(w) - k)
    df = df.withColumn("_h", F.when(alive & (F.size(w) > k), F.transform(at(), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))))
    df = df.withColumn("_dup", F.col("_h").isNotNull() & (F.size(F.array_distinct("_h")) < F.size("_h")))
    df = df.withColumn("_s", F.when(F.col("_dup"), F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_s")

    def equal(x: Column, y: Column) -> Column:
        same = x["h"] == y["h"]
        for j in range(k):
            same = same & (F.get(w, x["i"] + j) == F.get(w, y["i"] + j))
        return F.coalesce(same, F.lit(False))

    place = lambda x, n: F.when(equal(x, F.get(s, n - 1)) | equal(x, F.get(s, n + 1)), x["i"])
    df = df.withColumn("_p", F.when(s.isNotNull(), F.array_sort(F.filter(F.transform(s, place), lambda p: p.isNotNull()))))
    p = F.col("_p")
    covered = F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k))))
    n = F.when(p.isNull(), F.lit(0)).otherwise(F.aggregate(covered, F.lit(0), lambda a, x: a + x)).cast("long")
    return df.withColumn("n_repeat_words", F.when(alive, n)).drop("_h", "_dup", "_s", "_p")


def _lines(df: DataFrame, alive: Column) -> DataFrame:
    df = df.withColumn("_l", F.when(alive, lines_with_words(F.col("text"))))
    return df.withColumns({"n_lines": F.when(alive, F.size("_l").cast("long")), "n_dup_lines": F.when(alive, (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))}).drop("_l")


#: What adds a metric (or two) to a frame with ``text`` and ``words``: null where ``alive`` is false.
METRICS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "n_words": lambda df, alive: df.withColumn("n_words", F.when(alive, F.size("words").cast("long"))),
    "word_chars": lambda df, alive: df.withColumn("word_chars", F.when(alive, word_chars(F.col("words")))),
    "n_symbols": lambda df, alive: df.withColumn("n_symbols", F.when(alive, n_symbols(F.col("text")))),
    "n_dup_lines": _lines,
    "n_repeat_words": _repeat_words,
}

#: The first two are the fixed base rules; the others only reject what is hardly prose.
RULES = (
    Rule("few_words", ("n_words",), lambda: F.col("n_words") < MIN_WORDS),
    Rule("repeated_windows", ("n_words", "n_repeat_words"), lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    Rule("symbols", ("n_words", "n_symbols"), lambda: F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words")),
    Rule("duplicate_lines", ("n_dup_lines",), lambda: 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")),
    Rule("word_length", ("n_words", "word_chars"), lambda: ~(F.col("word_chars") / F.greatest("n_words", F.lit(1))).between(MIN_MEAN_WORD, MAX_MEAN_WORD)),
)


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as ``row``, its ``text`` (null: empty) and ``words``."""
    rows = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("text"))
    return rows.withColumn("words", space_words(F.col("text")))


def sampled(docs: DataFrame, id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, times: int = SAMPLE_TIMES) -> DataFrame:
    """``text`` and ``words`` of the rows with the least hashes of the id, cut to so many characters, so many times."""
    least = docs.select(F.xxhash64(F.col(id).cast("long")).alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    own = docs.where(F.xxhash64(F.col(id).cast("long")) <= F.lit(least)) if least is not None else docs.limit(0)
    own = own.select(F.left(text_or_empty(text), F.lit(chars)).alias("text")).limit(rows)
    own = own.select("text", space_words(F.col("text")).alias("words"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_n"))
    return own.drop("_n").coalesce(1)


def estimate(sample: DataFrame, rules: Sequence[Rule], runs: int = 2) -> dict[str, tuple[float, float]]:
    """Seconds a row and share of rows rejected, by rule: the least of some runs over the sample, after one that compiles,
    less what counting the sample takes."""

    def measured(df: DataFrame, reject: Column) -> tuple[float, int, int]:
        job = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(reject, F.lit(False))).alias("rejected"))
        n, rejected = job.collect()[0]
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            job.collect()
            took.append(time.perf_counter() - began)
        return min(took), n, rejected

    base, _, _ = measured(sample, F.size("words") < 0)
    out = {}
    for rule in rules:
        df = sample
        for m in rule.metrics:
            df = METRICS[m](df, F.lit(True))
        took, n, rejected = measured(df, rule.rejects())
        out[rule.name] = (max(took - base, 1e-4) / max(n, 1), rejected / max(n, 1))
    return out


def order(costs: dict[str, tuple[float, float]], rules: Sequence[Rule]) -> list[Rule]:
    """Rules by rejections per second, best first, those without rejections by their cost; ties stay in the given order."""
    return sorted(rules, key=lambda r: (-costs[r.name][1] / max(costs[r.name][0], 1e-9), costs[r.name][0]))


def ordered(sample: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    """The rules in the order that a sample suggests."""
    sample = sample.persist()
    try:
        return order(estimate(sample, rules), rules)
    finally:
        sample.unpersist()


def cascade(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``rejected_by`` to a frame with ``text`` and ``words``: the first rule, in the given order, that rejects the
    row, else null; and the metrics, each null where the row was rejected before a rule needed it."""
    df = df.withColumn("rejected_by", F.lit(None).cast("string"))
    have: set[str] = set()
    for rule in rules:
        alive = F.col("rejected_by").isNull()
        for m in rule.metrics:
            if m not in have:
                df = METRICS[m](df, alive)
                have.add(m)
        df = df.withColumn("rejected_by", F.when(alive, F.when(rule.rejects(), F.lit(rule.name))).otherwise(F.col("rejected_by")))
    return df


def filled(df: DataFrame, metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """The metrics that cascade() left null, or never needed, computed for the rows that lack them."""
    for m in metrics:
        if m not in df.columns:
            df = METRICS[m](df, F.lit(True))
            continue
        df = df.withColumn("_had", F.col(m))
        extra = {c: F.col(c) for c in ("n_lines",) if m == "n_dup_lines"}
        df = df.withColumns({f"_{c}": v for c, v in extra.items()})
        df = METRICS[m](df, F.col("_had").isNull()).withColumn(m, F.coalesce("_had", m))
        df = df.withColumns({c: F.coalesce(f"_{c}", c) for c in extra}).drop("_had", *[f"_{c}" for c in extra])
    return df


def verdicts(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """``row``, ``rejected_by`` and the metrics that the cascade came to."""
    out = cascade(prepared(docs, text), rules).drop("text", "words")
    # explode keeps a later filter on the verdict above this point: pushed below, it would copy the rules into each other
    return out.withColumn("rejected_by", F.explode(F.array("rejected_by")))


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", id: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with ``rejected_by``, by the cascade in the order that the sample suggests."""
    docs = docs.drop("rejected_by")
    return verdicts(docs, ordered(sampled(docs, id, text, sample_rows), rules), text).select("row.*", "rejected_by")
