"""Whether a claim's verdict from stored evidence stands, so that no search is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import words
from plumbline.functions.once import once

#: Behaviours that a claim and its facts must share, and how texts speak of them.
BEHAVIOURS = {
    "physical_activity": r"\b(physical activity|exercise|active lifestyle|aerobic|workout|training)\b",
    "sedentary": r"\b(sedentary|physical inactivity|inactive lifestyle|sitting time)\b",
    "sleep": r"\b(sleep|sleep deprivation|insomnia|sleep duration|sleep quality)\b",
    "smoking": r"\b(smoking|smoker|tobacco|nicotine)\b",
    "alcohol": r"\b(alcohol|drinking|binge drinking)\b",
    "fasting": r"\b(fasting|time-restricted eating|intermittent fasting)\b",
}
#: Reasons of parts that are not resolved.
UNRESOLVED = ("no_relevant_evidence", "insufficient_admissible_evidence")
#: Probability of unverifiable that is too much, and the least confidence, coverage, admissible share, predicate match and share of words.
TOO_OPEN, SURE, WHOLE, ADMISSIBLE, MATCH, SHARED = 0.50, 0.62, 0.99, 0.35, 0.72, 0.30


def behaviours(x: Column) -> Column:
    """The behaviours that a text speaks of."""
    return F.filter(F.array(*[F.when(words.has(x, p), F.lit(name)) for name, p in BEHAVIOURS.items()]), lambda t: t.isNotNull())


def _status(segment: Column) -> Column:
    status = F.upper(F.coalesce(segment["status"], F.lit("")))
    return F.when(status == "", "UNKNOWN").otherwise(status)


def _grounded(segment: Column, claim_behaviours: Column) -> Column:
    """A part that counts as valid rests on a fact that matches its predicate, shares its words, and speaks of the same behaviour."""
    own, fact = (words.token_set(words.low(segment[x]), words.ALPHA, words.STOP) for x in ("claim_segment", "supporting_fact"))
    alike = once(F.struct(own.alias("a"), fact.alias("b")), lambda s: (F.size(s["a"]) == 0) | (F.size(s["b"]) == 0) | (words.shared(s["a"], s["b"]) >= SHARED * F.size(s["a"])))
    same = once(behaviours(segment["supporting_fact"]), lambda b: (F.size(claim_behaviours) == 0) | (F.size(b) == 0) | F.arrays_overlap(claim_behaviours, b))
    return (F.coalesce(segment["predicate_match_score"], F.lit(0.0)) >= MATCH) & alike & same


def allowed(trust: Column, result: Column, segments: Column, in_context: Column) -> Column:
    """Whether stored evidence is enough.

    trust: struct of is_sufficient, coverage, num_subclaims, strong_covered.
    result: struct of verdict, unverifiable, confidence, admissible_ratio (null:
    not counted), supports, contradicts, claim, required_resolved (null: not
    known); or null. segments: the verdict's parts (status, reason,
    predicate_match_score, claim_segment, supporting_fact). in_context: of the
    ranked rows, whether each was found for this claim; null or empty if none.
    """
    number = lambda x: F.coalesce(x, F.lit(0.0))
    verdict = F.upper(F.coalesce(result["verdict"], F.lit("")))
    parts = F.coalesce(F.size(segments), F.lit(0))
    many, cov = F.coalesce(trust["num_subclaims"], F.lit(0)), number(trust["coverage"])
    sure = (verdict != "UNVERIFIABLE") & (number(result["unverifiable"]) < TOO_OPEN) & (~verdict.isin("TRUE", "FALSE") | (number(result["confidence"]) >= SURE))
    own = (F.coalesce(F.size(in_context), F.lit(0)) == 0) | F.exists(F.slice(in_context, 1, 5), lambda x: F.coalesce(x, F.lit(False)))
    covered = (many > 0) & (F.coalesce(trust["strong_covered"], F.lit(0)) >= many) & (cov >= WHOLE) & result.isNull()
    counted = result["admissible_ratio"].isNull() | ((result["admissible_ratio"] >= ADMISSIBLE) & (F.coalesce(result["supports"], F.lit(0)) + F.coalesce(result["contradicts"], F.lit(0)) > 0))
    open_ = F.exists(segments, lambda s: F.lower(F.coalesce(s["reason"], F.lit(""))).isin(*UNRESOLVED))
    rests = once(behaviours(result["claim"]), lambda b: ~F.exists(segments, lambda s: _status(s).isin("VALID", "PARTIALLY_VALID") & ~_grounded(s, b)))
    known = F.coalesce(result["required_resolved"], (parts > 0) & ~F.coalesce(F.exists(segments, lambda s: _status(s) == "UNKNOWN"), F.lit(False)))
    judged = ((many == 0) | (cov >= WHOLE)) & counted & ((parts == 0) | (~open_ & rests)) & known
    return F.coalesce(trust["is_sufficient"], F.lit(False)) & sure & own & (covered | F.coalesce(judged, F.lit(False)))
