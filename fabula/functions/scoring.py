"""Scalar scoring expressions: clamps, step scorers, labels, cascades, intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard normal quantile of 0.975 (fixed value).
Z95 = 1.959963984540054


def ladder(value: Column, steps: Sequence[tuple[float, float]], otherwise: float | None, down: bool = False) -> Column:
    """The score of the first step that ``value`` reaches (``>=``), or with ``down`` stays within (``<=``)."""
    out = F.lit(otherwise).cast("double")
    for bound, score in reversed(steps):
        out = F.when(value <= bound if down else value >= bound, F.lit(float(score))).otherwise(out)
    return out


def clamp(value: Column, low: float, high: float) -> Column:
    """Between the bounds; a null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def label(value: Column, cuts: Sequence[tuple[float, str]], otherwise: str, missing: str | None = None) -> Column:
    """The name of the first cut that ``value`` reaches."""
    out = F.lit(otherwise)
    for bound, name in reversed(cuts):
        out = F.when(value >= bound, name).otherwise(out)
    return F.when(value.isNull(), F.lit(missing)).otherwise(out)


def confidence_label(value: Column) -> Column:
    return label(value, [(0.75, "high"), (0.45, "medium")], "low", "low")


def tier(score: Column, p25: Column, p50: Column, p75: Column) -> Column:
    """Tier by cut-offs; insufficient without a score."""
    return (
        F.when(score.isNull(), "insufficient").when(score >= p75, "excellent").when(score >= p50, "good").when(score >= p25, "weak").otherwise("poor")
    )


def least_label(labels: Column, order: Sequence[str] = ("low", "medium", "high")) -> Column:
    """The lowest of an array of labels."""
    ranks = F.transform(labels, lambda x: F.array_position(F.array(*map(F.lit, order)), x))
    return F.element_at(F.array(*map(F.lit, order)), F.array_min(ranks).cast("int"))


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """Lower bound of the Wilson interval of k of n; 0 without items."""
    p = ratio(k, n)
    z2 = z * z
    spread = z * F.sqrt(F.greatest(F.lit(0.0), ratio(p * (1 - p), n) + ratio(F.lit(z2 / 4), n * n)))
    return F.when(n > 0, F.greatest(F.lit(0.0), (p + ratio(F.lit(z2 / 2), n) - spread) / (1 + ratio(F.lit(z2), n)))).otherwise(0.0)


def cosine(a: Column, b: Column, empty: float = 0.0, ragged: bool = True) -> Column:
    """Cosine of two arrays. ``ragged``: the longer one is cut; else other lengths give ``empty``, as zero norms do."""
    if ragged:
        n = F.least(F.size(a), F.size(b))
        a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    square = lambda x: total(F.transform(x, lambda v: v.cast("double") * v.cast("double")))
    norms = F.sqrt(square(a)) * F.sqrt(square(b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot / norms).otherwise(F.lit(float(empty)))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Similarity of two arrays as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, ratio(F.size(F.array_intersect(a, b)), union)).otherwise(F.lit(both_empty))


def decay(hours: Column, rate: float = 0.1) -> Column:
    return F.exp(-rate * hours)


def hours_between(now: Column, then: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", then, now) / 3.6e9


def pick(key: Column, n: Column | int) -> Column:
    """A number below n that depends on the key alone: the first 32 bits of its SHA-256, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint"), F.lit(n) if isinstance(n, int) else n)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
