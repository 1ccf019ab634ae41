"""Personal data (native): fixed patterns, and weak supervision for what they miss.

Candidates beyond the fixed patterns are runs of digits and separators, and pairs of capitalised words. Labelers (shape
patterns, a gazetteer of given names, words of the context) vote on each: for, against, or not at all. The votes on the
candidates of all documents are counted by pattern; expectation-maximisation over these counts estimates how reliable each
labeler is, and a posterior for each pattern. A logistic span classifier is then trained on
the candidates' features, among them some that no labeler looks at, with the posteriors as soft labels, also from counts.
Candidates of all documents that it accepts become spans; fixed spans always stay. The gazetteer is GIVEN_NAMES and at most
LEARNED_NAMES more: first words of pairs that stand behind titles and greetings, the most frequent first. The counts have
at most 3^labelers x 2^features rows whatever the corpus; only they and the learned names reach the driver.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned one by one (and count twice); an
empty table gives an empty result; further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, text_or_empty, written
from .spans import digits, overlaps, with_spans

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, in the order in which spans list them.
MORE_KINDS = ("number", "person")

_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A local phone number or a national id that no digit touches; a run of digits and separators is cut at these.
_SHAPE = r"(?<![0-9])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])"
NUMBER = rf"{_SHAPE}|(?:\G|(?<![0-9\x20().-]))(?:(?!{_SHAPE})[0-9\x20().-]){{8,}}+"
PERSON = r"(?<![A-Za-z])[A-Z][a-z]++\x20[A-Z][a-z]++(?![A-Za-z])"

#: Given names of the gazetteer (fixed values).
GIVEN_NAMES = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Anna Maria Peter Hans Klaus Petra Sabine Wolfgang Jean Pierre Marie Sophie Michel Nathalie Jose Juan Carlos Carmen Ana Luis"
).split()
#: Least probability of an added span, most rounds of the two fits, and the ridge of the second.
ACCEPT, EM_ROUNDS, FIT_ROUNDS, RIDGE = 0.9, 60, 50, 1e-3
#: Most names that are learned; how often a name must stand behind a title or greeting, and in what share of all its
#: places as the first of two capitalised words.
LEARNED_NAMES, NAME_SEEN, NAME_SHARE = 1000, 3, 0.2

_FOR_CONTEXT = r"(?i)(?:phone|tel|telephone|mobile|call|fax|contact|ssn|id number|name|signed|dear|teléfono|téléphone|telefon|handy)[^\n]{0,8}$"
_OTHER_CONTEXT = r"(?i)(?:version|isbn|page|no\.|figure|table|order|price|total|year|section|chapter|seite|seit)[^\n]{0,8}$"
_GREETING = r"(?i:dear|hello|hi|hallo|liebe|lieber|bonjour|chère|cher|hola|signed|regards),?\x20$"
_HONORIFIC = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20$"
_LOCAL_PHONE = r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"
_NATIONAL_ID = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
#: Letters and digits before and after a number that make it a part of a hexadecimal string.
_HEX_BEFORE = r"(?:^|[^A-Za-z0-9_])(?:0?[xX][0-9A-Fa-f_]*|[0-9A-Fa-f_]+)$"
_HEX_AFTER = r"^[0-9A-Fa-f_]+(?:[^A-Za-z0-9_]|$)"
_DATE_OR_AMOUNT = r"^(?:[0-9]{1,4}[-.][0-9]{1,2}[-.][0-9]{1,4}|[0-9]+(?:\.[0-9]+)?)$"


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.char_length(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def is_card(value: Column) -> Column:
    d = digits(value)
    return F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(False)


def with_base_spans(df: DataFrame) -> DataFrame:
    """Adds email, ip, card, phone and ``base`` (arrays of spans) to a frame with ``text``."""
    df = with_spans(df, "email", "email", EMAIL)
    df = with_spans(df, "ip", "ip", IP, lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
    df = with_spans(df, "card", "card", CARD, is_card)
    df = with_spans(df, "phone", "phone", PHONE, lambda v: F.char_length(digits(v)).between(9, 15))
    return df.withColumn("base", F.concat(*BASE_KINDS))


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds ``candidates``: spans with context and whether a fixed span overlaps them. Numbers are cut out
    of longer runs where they have the shape of a phone number or national id, trimmed to their digits and opening bracket,
    have 7 to 15 digits and are no part of a hexadecimal string."""
    df = with_spans(df, "_number", "number", NUMBER, lambda v: F.char_length(digits(v)).between(7, 15), context=True)
    df = with_spans(df, "_person", "person", PERSON, context=True)

    def trim(s: Column) -> Column:
        head = F.char_length(F.regexp_extract(s["value"], r"^[\x20).-]*+(?:\((?![0-9])[\x20().-]*+)?", 0))
        bare = F.regexp_replace(F.substring(s["value"], head + 1, F.char_length(s["value"])), r"[^0-9]++$", "")
        start = s["start"] + head
        inside = (head == 0) & s["left"].rlike(_HEX_BEFORE) | (start + F.char_length(bare) == s["end"]) & s["right"].rlike(_HEX_AFTER)
        value = F.when(inside, F.lit("")).otherwise(bare)
        return F.struct(s["kind"].alias("kind"), start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"), s["left"].alias("left"), s["right"].alias("right"))

    numbers = F.filter(F.transform("_number", trim), lambda s: s["value"] != "")
    both = F.concat(numbers, F.col("_person"))
    fields = ("kind", "start", "end", "value", "left", "right")
    # let: Catalyst would otherwise move the expression of base into the lambda and evaluate it for each candidate
    marked = let(F.col("base"), lambda base: F.transform(both, lambda s: F.struct(*[s[c].alias(c) for c in fields], overlaps(s, base).alias("known"))))
    return df.withColumn("candidates", marked).drop("_number", "_person")


def learned_names(candidates: DataFrame, most: int = LEARNED_NAMES) -> list[str]:
    """First words of persons (rows with ``s``) that often follow titles and greetings, the most frequent first."""
    s = F.col("s")
    titled = s["left"].rlike(_HONORIFIC) | s["left"].rlike(_GREETING)
    one = candidates.where(s["kind"] == "person").groupBy(F.substring_index(s["value"], " ", 1).alias("name")).agg(F.count_if(titled).alias("n"), F.count(F.lit(1)).alias("all"))
    kept = one.where((F.col("n") >= NAME_SEEN) & (F.col("n") >= NAME_SHARE * F.col("all")) & ~F.col("name").isin(GIVEN_NAMES))
    return sorted(r["name"] for r in kept.orderBy(F.desc("n"), "name").limit(most).collect())


def votes(s: Column, names: Sequence[str] = GIVEN_NAMES) -> list[Column]:
    """A vote of each labeler on a candidate: 1 for, -1 against, 0 none."""
    number, person = s["kind"] == "number", s["kind"] == "person"
    given = F.substring_index(s["value"], " ", 1).isin(list(names))
    one = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    return [
        one(number & (s["known"] | s["value"].rlike(_LOCAL_PHONE)), 1),
        one(number & s["value"].rlike(_NATIONAL_ID), 1),
        one(number & (s["value"].rlike(_DATE_OR_AMOUNT) | s["value"].rlike(r"^([0-9])(?:[\x20().-]*\1)+$")), -1),
        F.when(person & given, 1).when(person, -1).otherwise(0),
        one(person & s["left"].rlike(_HONORIFIC), 1),
        F.when(s["left"].rlike(_FOR_CONTEXT), 1).when(s["left"].rlike(_OTHER_CONTEXT), -1).otherwise(0),
    ]


def features(s: Column, names: Sequence[str] = GIVEN_NAMES) -> list[Column]:
    """Conditions that the span classifier weighs; no labeler looks at the last four."""
    n = F.char_length(digits(s["value"]))
    return [
        s["kind"] == "person",
        s["value"].rlike(_LOCAL_PHONE),
        s["value"].rlike(_NATIONAL_ID),
        n.between(9, 12),
        s["value"].rlike(r"^[0-9]+$"),
        s["value"].rlike(_DATE_OR_AMOUNT),
        F.substring_index(s["value"], " ", 1).isin(list(names)),
        s["left"].rlike(_HONORIFIC),
        s["left"].rlike(_FOR_CONTEXT),
        s["left"].rlike(_OTHER_CONTEXT),
        s["left"].rlike(r"(?:^|[.!?\n])\x20*$"),
        s["left"].rlike(r"[:=]\x20?$"),
        s["right"].rlike(r"^(?:[,;.)]|\n|$)"),
        s["value"].rlike(r"[0-9][^0-9]+[0-9]+[^0-9]+[0-9]"),
    ]


def estimate(counts: dict[tuple[int, ...], float], rounds: int = EM_ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior of each pattern of votes, by expectation-maximisation over counts of patterns. Each labeler has a
    distribution of its three votes for either class; Dirichlet priors hold a labeler to be right more often than not."""
    if not counts:
        return {}
    n = len(next(iter(counts)))
    post = {p: min(0.95, max(0.05, 0.2 + 0.35 * sum(p))) for p in counts}
    prior = {1: {1: 4.0, 0: 4.0, -1: 1.0}, 0: {1: 1.0, 0: 4.0, -1: 4.0}}
    for _ in range(rounds):
        weight = {1: 1.0, 0: 4.0}
        told = {y: [dict(prior[y]) for _ in range(n)] for y in (0, 1)}
        for p, c in counts.items():
            for y, share in ((1, post[p]), (0, 1 - post[p])):
                weight[y] += c * share
                for j, v in enumerate(p):
                    told[y][j][v] += c * share
        for p in counts:
            logs = {y: math.log(weight[y]) + sum(math.log(told[y][j][v] / sum(told[y][j].values())) for j, v in enumerate(p)) for y in (0, 1)}
            post[p] = 1 / (1 + math.exp(min(700, logs[0] - logs[1])))
    return post


def solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b, for a small positive definite matrix."""
    n, m = len(b), [[*row, v] for row, v in zip(a, b, strict=True)]
    for i in range(n):
        for r in range(i + 1, n):
            f = m[r][i] / m[i][i]
            for c in range(i, n + 1):
                m[r][c] -= f * m[i][c]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (m[i][n] - sum(m[i][c] * x[c] for c in range(i + 1, n))) / m[i][i]
    return x


def fit(rows: Sequence[tuple[tuple[int, ...], float, float]], rounds: int = FIT_ROUNDS) -> list[float]:
    """Weights (bias last) of a logistic model from (features, posterior, count), by Newton steps with a small ridge, until
    they no longer move."""
    n = len(rows[0][0]) if rows else 0
    w, total = [0.0] * n + [-2.0], sum(c for _, _, c in rows)
    for _ in range(rounds if total else 0):
        grad = [RIDGE * x for x in w]
        curve = [[RIDGE * (i == j) for j in range(n + 1)] for i in range(n + 1)]
        for x, y, c in rows:
            on = [j for j in range(n) if x[j]] + [n]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[j] for j in on)))))
            for i in on:
                grad[i] += c / total * (p - y)
                for j in on:
                    curve[i][j] += c / total * p * (1 - p)
        step = solved(curve, grad)
        scale = min(1.0, 4.0 / max(1e-9, *map(abs, step)))
        w = [a - scale * d for a, d in zip(w, step, strict=True)]
        if max(map(abs, step)) < 1e-6:
            break
    return w


def train(df: DataFrame) -> tuple[list[float], list[str]]:
    """The span classifier and the names of the gazetteer, from all candidates of a frame with ``candidates``."""
    # outer: else Catalyst infers a filter on the array and copies all of its expression below the other columns
    one = written(df.select(F.explode_outer("candidates").alias("s")).where("s IS NOT NULL"), "pii-candidates")
    names = [*GIVEN_NAMES, *learned_names(one)]
    s = F.col("s")
    v, x = F.array(*votes(s, names)), F.array(*[c.cast("int") for c in features(s, names)])
    rows = one.groupBy(v.alias("v"), x.alias("x")).count().collect()  # at most 3^votes x 2^features rows
    counts: dict[tuple[int, ...], float] = {}
    for r in rows:
        counts[tuple(r["v"])] = counts.get(tuple(r["v"]), 0) + r["count"]
    post = estimate(dict(sorted(counts.items())))
    return fit(sorted((tuple(r["x"]), post[tuple(r["v"])], float(r["count"])) for r in rows)) if rows else [], names


def accepted(s: Column, weights: Sequence[float], names: Sequence[str] = GIVEN_NAMES) -> Column:
    """Whether the classifier takes a candidate for personal data."""
    if not weights:
        return F.lit(False)
    z = sum((F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in zip(features(s, names), weights, strict=False)), F.lit(weights[-1]))
    return 1 / (1 + F.exp(-z)) >= ACCEPT


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as ``row``, its ``text``, the fixed spans by kind, ``base``, and ``found``: fixed spans by kind and start,
    then the added ones likewise. The classifier is fitted on the candidates of all documents, so they are scanned twice."""
    weights, names = train(with_candidates(with_base_spans(docs.select(text_or_empty(text).alias("text")))))
    df = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("text"))
    df = with_candidates(with_base_spans(df))
    more = F.filter("candidates", lambda s: ~s["known"] & accepted(s, weights, names))
    bare = F.transform(more, lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value")]))
    return df.withColumn("found", F.concat("base", bare)).drop("candidates")
