"""Scores, grades and bands as column expressions. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def whole_days(ts: Column, now: Column) -> Column:
    """Days from ts to now, rounded down."""
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(ts)) / 86400)


def recency_decay(ts: Column, now: Column) -> Column:
    """Halves every 365 days; 1 for the future, 0 for no date."""
    return F.when(ts.isNull(), 0.0).otherwise(clamp01(F.pow(F.lit(0.5), whole_days(ts, now) / 365.0)))


def recency_bucket(ts: Column, now: Column) -> Column:
    """1, .8, .6, .4 or .3 for up to half a year, one, three, five years or more; .5 for no date."""
    d = whole_days(ts, now)
    return F.when(d.isNull(), 0.5).when(d < 180, 1.0).when(d < 365, 0.8).when(d < 1095, 0.6).when(d < 1825, 0.4).otherwise(0.3)


def stance_share(stance: Column) -> Column:
    """entails 1, neutral .5, contradicts 0."""
    return F.when(stance == "entails", 1.0).when(stance == "contradicts", 0.0).otherwise(0.5)


def trust(semantic: Column, source: Column, recency: Column, stance: Column) -> Column:
    return clamp01(0.3 * semantic + 0.3 * source + 0.2 * recency + 0.2 * stance_share(stance))


def grade(score: Column) -> Column:
    """Letter of one row's score."""
    return F.when(score >= 0.9, "A+").when(score >= 0.8, "A").when(score >= 0.7, "B").when(score >= 0.6, "C").when(score >= 0.5, "D").otherwise("F")


def post_grade(trust: Column) -> Column:
    """Letter of a claim's trust, whose bounds are lower."""
    return F.when(trust >= 0.85, "A+").when(trust >= 0.75, "A").when(trust >= 0.65, "B").when(trust >= 0.50, "C").when(trust >= 0.35, "D").otherwise("F")


def semantic_label(score: Column) -> Column:
    """How sure a vector score is, in a word."""
    return F.when(score >= 0.9, "HIGH").when(score >= 0.75, "GOOD").when(score >= 0.6, "FAIR").when(score >= 0.4, "LOW").otherwise("NONE")


def truth_band(score: Column) -> Column:
    """In which of five bands a truthfulness of 0 to 100 lies; null counts as 0."""
    x = F.coalesce(score, F.lit(0.0))
    return F.when(x <= 24, "LIKELY_FALSE").when(x <= 44, "MOSTLY_FALSE").when(x <= 55, "MIXED_OR_UNCLEAR").when(x <= 74, "MOSTLY_TRUE").otherwise("LIKELY_TRUE")


def untrusted_band(score: Column) -> Column:
    """The band where trust failed, which has no likely ends."""
    x = F.coalesce(score, F.lit(0.0))
    return F.when(x <= 44, "MOSTLY_FALSE").when(x <= 55, "MIXED_OR_UNCLEAR").otherwise("MOSTLY_TRUE")


def support_contradiction(anchor: Column, predicate: Column, semantic: Column, trusted: Column, contradiction: Column, intervention: Column) -> tuple[Column, Column]:
    """Logistic support and contradiction of one statement; the coefficients are fixed values."""
    support = 1.35 * semantic + 1.10 * anchor + 1.15 * predicate + 0.55 * trusted + 0.40 * intervention - 1.85 * contradiction - 1.05
    against = 1.30 * contradiction + 0.70 * predicate + 0.35 * trusted + 0.20 * intervention - 0.80 * semantic - 0.55 * anchor - 0.85
    return sigmoid(support), sigmoid(against)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
