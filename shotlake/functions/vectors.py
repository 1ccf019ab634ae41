"""Vector functions as columns: interpreted folds in DOUBLE, no Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to each norm, and to a histogram's sum and a score's range.
EPS = 1e-7
#: Added to the denominator of the chi-squared distance.
CHI_EPS = 1e-10
#: Bins of a channel and values of a channel.
BINS, LEVELS = 64, 256


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Plain inner product; relevance of vectors that are normalised already."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with EPS added to each norm, so a self match is just below 1."""
    return dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row and not for each element that body visits."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalise(v: Column, eps: float = EPS) -> Column:
    return once(v, lambda u: once(norm(u) + eps, lambda n: F.transform(u, lambda x: x / n)))


def chi_squared(a: Column, b: Column) -> Column:
    """Half the sum of (a - b)^2 / (a + b + 1e-10)."""
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y) / (x + y + CHI_EPS))) / 2


def bin_of(value: Column, bins: int = BINS) -> Column:
    """Which of the equal bins over [0, 256) a channel value falls in."""
    return F.floor(value * bins / LEVELS).cast("int")


def l1(v: Column) -> Column:
    """v divided by its sum plus EPS."""
    return once(v, lambda u: once(total(u) + EPS, lambda n: F.transform(u, lambda x: x / n)))


def min_max(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low + EPS)


def fingerprint(v: Column) -> Column:
    """16 hex characters over the size and the first and last four values in micro-units; vectors that agree there collide."""
    part = lambda p: F.transform(p, lambda x: F.round(x * 1e6).cast("long").cast("string"))
    return F.substring(F.md5(F.concat_ws(",", F.size(v).cast("string"), F.array_join(part(F.slice(v, 1, 4)), ","), F.array_join(part(F.slice(v, -4, 4)), ",")).cast("binary")), 1, 16)


def full_fingerprint(v: Column) -> Column:
    """32 hex characters over all values in micro-units."""
    return F.md5(F.array_join(F.transform(v, lambda x: F.round(x * 1e6).cast("long").cast("string")), ",").cast("binary"))


def to_json(v: Column) -> Column:
    return F.to_json(v)


def from_json(text: Column) -> Column:
    """Null where the text is not an array of numbers."""
    return F.from_json(text, "array<double>")
