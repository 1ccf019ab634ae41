"""Secret scans (native): fixed patterns, and character Markov models for what no pattern names.

Two bigram models of characters are counted from labelled samples, one of random strings and one of ordinary
identifiers. A token's score is the log-likelihood ratio of the two; tokens above both thresholds are secrets too.
The model is a table of 128 x 128 ratios, so its size is fixed.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned one by one; an empty table gives
an empty result (the model then knows only its generated identifiers); further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, space_words, text_or_empty
from .spans import overlaps, with_spans

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: In the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "markov")

#: Tokens that the models score.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Least sum and least mean (per pair of characters) of the log-likelihood ratio.
MIN_SUM, MIN_MEAN = 14.0, 0.6
#: Bounds of the labelled samples: generated random strings, and documents whose words make identifiers.
RANDOM_STRINGS, IDENTIFIER_DOCS = 4000, 400
#: Characters that a token may have.
_ALPHABET = 67
_SIZE = 128


def with_base_spans(df: DataFrame) -> DataFrame:
    """Adds the columns assign, access, hex (arrays of spans) to a frame with ``text``."""
    df = with_spans(df, "assign", "assign", ASSIGN, lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 1)) >= 6)
    df = with_spans(df, "access", "access", ACCESS)
    return with_spans(df, "hex", "hex", HEX)


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled samples of secrets: digests of numbers in hexadecimal, base 64 and its url form, and capitals."""
    h = F.sha2(F.concat(F.lit("sample:"), F.col("id")).cast("binary"), 256)
    b64 = F.base64(F.unhex(h))
    kinds = F.array(F.substring(h, 1, 40), F.substring(b64, 1, 40), F.translate(F.substring(b64, 2, 32), "+/", "-_"), F.upper(F.regexp_replace(b64, "[^A-Za-z0-9]", "")))
    return spark.range(n).select(F.get(kinds, (F.col("id") % 4).cast("int")).alias("token"))


def identifiers(docs: DataFrame, n_docs: int = IDENTIFIER_DOCS, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Labelled samples of ordinary identifiers: words of n_docs documents (the first by a hash of the id) in camel,
    snake, kebab and path form, some with a number, and a few fixed ones."""
    spark = docs.sparkSession
    ids = [r[0] for r in docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(n_docs).collect()]
    fixed = ["getElementById", "application_configuration", "max-retry-count-2024", "src/main/java/com/example/ServiceFactory", "user_profile_picture_url", "2024-01-31T00-00-00", "INTERNAL_SERVER_ERROR_500"]
    given = spark.createDataFrame([(x,) for x in fixed], "token string")
    if not ids:
        return given
    words = F.filter(F.transform(space_words(text_or_empty(text)), lambda w: F.regexp_replace(w, "^[^A-Za-z]+|[^A-Za-z]+$", "")), lambda w: w.rlike("^[A-Za-z]+$"))
    own = docs.where(F.col(id).cast("long").isin(ids)).select(words.alias("w"))
    part = lambda i, k: F.slice(F.col("w"), i, F.lit(k))
    forms = lambda i: F.array(
        F.array_join(F.transform(part(i, 3), F.initcap), ""),
        F.lower(F.array_join(part(i, 3), "_")),
        F.lower(F.array_join(part(i, 2), "-")),
        F.array_join(part(i, 4), "/"),
        F.concat(F.array_join(part(i, 2), "_"), (i % 97).cast("string")),
    )
    made = own.where(F.size("w") >= 5).select(F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w") - 4, F.lit(5)), forms))).alias("token"))
    return made.unionByName(given)


def codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.least(F.ascii(c), F.lit(_SIZE - 1)))


def train(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratios of each pair of characters, at 128 * first + second, from tables with ``token``."""
    both = random.select("token", F.lit(1).alias("y")).unionByName(ordinary.select("token", F.lit(0).alias("y")))
    pairs = both.select("y", codes(F.col("token")).alias("c")).where(F.size("c") > 1)
    pairs = pairs.select("y", F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.get("c", i - 1) * _SIZE + F.get("c", i))).alias("pair"))
    counts: tuple[dict, dict] = ({}, {})
    for r in pairs.groupBy("y", "pair").count().collect():  # at most 2 x 128 x 128 rows
        counts[r["y"]][r["pair"]] = r["count"]

    def logs(got: dict[int, int]) -> list[float]:
        firsts = [sum(got.get(a * _SIZE + b, 0) for b in range(_SIZE)) for a in range(_SIZE)]
        return [math.log((got.get(k, 0) + 0.5) / (firsts[k // _SIZE] + 0.5 * _ALPHABET)) for k in range(_SIZE * _SIZE)]

    return [a - b for a, b in zip(logs(counts[1]), logs(counts[0]), strict=True)]


def table(ratios: Iterable[float]) -> Column:
    """The model as one constant array."""
    return F.split(F.lit(" ".join(f"{x:.4f}" for x in ratios)), " ").cast("array<double>")


def ratio(token: Column, model: Column) -> Column:
    """Sum of the log-likelihood ratios over the pairs of characters of a token."""
    return let(
        codes(token),
        lambda c: F.when(F.size(c) < 2, F.lit(0.0)).otherwise(
            F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda a, i: a + F.get(model, F.get(c, i - 1) * _SIZE + F.get(c, i)))
        ),
    )


def is_secret(token: Column, model: Column) -> Column:
    return let(ratio(token, model), lambda s: (s >= MIN_SUM) & (s >= MIN_MEAN * F.char_length(token)))


def with_all_spans(df: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds the base spans, ``found``: base and model's spans by start, then by kind, and ``touched``: tokens that overlap a
    base span. Such a token is left to the base span; extended() is for callers that cut secrets out."""
    model = table(ratios)
    df = with_base_spans(df).withColumn("base", F.concat("assign", "access", "hex"))
    df = with_spans(df, "markov", "markov", TOKEN)
    # let: keeps Catalyst from moving the expression of base into the lambda
    df = df.withColumn("touched", let(F.col("base"), lambda base: F.filter("markov", lambda s: overlaps(s, base))))
    df = df.withColumn("markov", let(F.col("base"), lambda base: F.filter("markov", lambda s: ~overlaps(s, base) & is_secret(s["value"], model))))
    return df.withColumn("base", by_start(F.col("base"))).withColumn("found", by_start(F.concat("base", "markov")))


def extended(found: Column, touched: Column) -> Column:
    """Spans of ``found``, each from the first to the last character of the tokens of ``touched`` that overlap it."""

    def grown(s: Column) -> Column:
        own = F.filter(touched, lambda t: (t["start"] < s["end"]) & (t["end"] > s["start"]))
        start = F.least(s["start"], F.coalesce(F.array_min(F.transform(own, lambda t: t["start"])), s["start"]))
        end = F.greatest(s["end"], F.coalesce(F.array_max(F.transform(own, lambda t: t["end"])), s["end"]))
        return F.struct(s["kind"].alias("kind"), start.alias("start"), end.alias("end"), s["value"].alias("value"))

    return F.when(F.size(touched) == 0, found).otherwise(by_start(F.transform(found, grown)))


def by_start(spans: Column) -> Column:
    rank = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """docs as ``row``, its ``text``, the base spans by kind, ``base`` and ``found``. Fits the models first."""
    spark = docs.sparkSession
    ratios = train(random_strings(spark), identifiers(docs, text=text, id=id))
    return with_all_spans(docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("text")), ratios)


def redacted(text: Column, found: Column) -> Column:
    """The text with each span of ``found`` (by start; they may overlap) replaced by its kind in angle brackets."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        piece = F.when(fresh, F.concat(gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["out"], piece).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    body = F.aggregate(found, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(found) > 0, body).otherwise(text)
