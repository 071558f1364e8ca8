"""Where a statement stands towards a claim, by what both say causes what, and frames of claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import words
from plumbline.functions.words import contains_any, has, low

#: Causal verbs, what denies them, and words that are no target.
CAUSES = r"(?:cause(?:s|d|ing)?|contribut(?:e|es|ed|ing)\s+to|lead(?:s|ing)?\s+to|result(?:s|ed|ing)?\s+in)"
DENIED = rf"(?:not|never|no)\s+{CAUSES}\s+([^.;:!?]+)"
SAID = rf"(\b(?:not|never|no)\s+)?\b{CAUSES}\s+([^.;:!?]+)"
NO_TARGET = (
    "the", "a", "an", "and", "or", "of", "in", "on", "to", "for", "with", "by", "is", "are", "was", "were", "be", "been", "being", "do", "does", "did", "not", "no", "never",
    "may", "might", "can", "could", "will", "would", "should", "that", "this", "these", "those", "it", "its", "their",
)
#: Words that deny and that affirm, where nothing causal is said.
AGAINST, FOR = ("not", "false", "incorrect", "debunked"), ("supports", "confirms", "true", "accurate")
#: Comparison in claims, in evidence, and what is counted there.
COMPARED = r"\b(more|less|fewer|greater|higher|lower|sooner|faster|slower|longer|shorter)\b.{0,80}\bthan\b|\bvs\b|\bversus\b|\bcompared to\b"
COMPARES = r"\b(than|compared to|versus|vs|sooner|faster|slower|longer|shorter|higher|lower)\b"
QUANTIFIED = r"\b\d+(?:\.\d+)?\b|\b(days?|hours?|weeks?|months?|years?|mortality|survival)\b"
NO_TERM = ("more", "less", "than", "with", "from", "lack", "human", "humans", "can", "die")
TERM = r"\b[a-z][a-z0-9_-]{2,}\b"


def _targets(clauses: Column) -> Column:
    return words.token_set(F.array_join(clauses, " \n "), words.ALPHA, NO_TARGET)


def denied_targets(x: Column) -> Column:
    """Words of what the text says is not caused."""
    return _targets(F.regexp_extract_all(low(x), F.lit(DENIED), F.lit(1)))


def caused_targets(x: Column) -> Column:
    """Words of what the text says is caused; parts that begin with a negation, and denied verbs, do not count."""
    text = low(x)
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(SAID), F.lit(1)), F.regexp_extract_all(text, F.lit(SAID), F.lit(2)), lambda d, c: F.when(F.coalesce(d, F.lit("")) == "", c))
    parts = F.flatten(F.transform(F.array_compact(pairs), lambda c: F.split(c, r"\bor\b|\band\b|,")))
    return _targets(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: ~(p.startswith("not ") | p.startswith("no ") | p.startswith("never "))))


def stance(claim: Column, evidence: Column) -> Column:
    """contradicts, entails or neutral."""
    cn, cp, en, ep = denied_targets(claim), caused_targets(claim), denied_targets(evidence), caused_targets(evidence)
    meet = F.arrays_overlap
    named = F.exists(F.filter(F.split(low(claim), r"(?U)\s+"), lambda w: w != ""), lambda w: F.contains(low(evidence), w))
    return (
        F.when(meet(cn, ep) | meet(cp, en), "contradicts").when(meet(cn, en) | meet(cp, ep), "entails")
        .when(contains_any(evidence, AGAINST) & named, "contradicts").when(contains_any(evidence, FOR) & named, "entails").otherwise("neutral")
    )


def restanced(given: Column, claim: Column, evidence: Column) -> Column:
    """The given stance; worked out where it is missing or neutral."""
    return F.when(F.coalesce(given, F.lit("neutral")).isin("", "neutral"), stance(claim, evidence)).otherwise(given)


def claim_frame(claim: Column) -> Column:
    """A struct: claim_type, strength, strong_therapeutic, comparative."""
    cures, strong = has(claim, r"\b(cure|cures|treat|treats|therapy|effective against)\b"), has(claim, r"\b(cure|cures|eradicate|eliminate)\b")
    return F.struct(
        F.when(cures, "THERAPEUTIC_EFFICACY").otherwise("GENERIC").alias("claim_type"), F.when(strong, "STRONG").otherwise("NORMAL").alias("strength"),
        (cures & strong).alias("strong_therapeutic"), has(claim, COMPARED).alias("comparative"),
    )


def comparative_hit(claim: Column, statement: Column) -> Column:
    """The statement compares, and counts or shares two words with the claim."""
    common = words.shared(words.token_set(claim, TERM, NO_TERM), words.token_set(statement, TERM))
    return has(statement, COMPARES) & (has(statement, QUANTIFIED) | (common >= 2))


def stop_reason(strong_therapeutic: Column, sufficient: Column, coverage: Column, diversity: Column, agreement: Column, trust: Column, strong: Column, contradicted: Column, parts: Column, urls: Column, gain: Column, zero_rounds: Column, low_rounds: Column, target: float = 0.5, most_urls: int = 12) -> Column:
    """Why a search in confidence mode ends; names that begin with 'continue' say that it does not."""
    return (
        F.when(urls >= most_urls, "url_cap").when(sufficient, "sufficient")
        .when(~strong_therapeutic & (contradicted >= F.greatest(F.lit(1), parts)) & (agreement >= 0.90) & (diversity >= 0.60) & (urls >= 6) & (trust <= 0.20), "stable_contradiction")
        .when(strong_therapeutic & (contradicted > 0) & (strong >= 1), "therapeutic_contradiction").when(strong_therapeutic & (coverage >= target) & (strong >= 1), "therapeutic_coverage").when(strong_therapeutic, "continue_therapeutic")
        .when((zero_rounds >= 2) & (gain < 0.15), "saturated").when((low_rounds >= 3) & (urls >= 6) & (gain < 0.18), "no_gain_expected")
        .when(coverage >= target, "continue_insufficient").otherwise("continue")
    )


def next_action(iteration: Column, trust: Column, delta: Column, threshold: float = 0.75, least: float = 0.02) -> Column:
    """Whether the trust loop goes on."""
    return F.when(trust >= threshold, "stop_threshold_met").when(iteration == 1, "trigger_corrective").when(delta < least, "stop_no_improvement").otherwise("trigger_corrective")


def decision(trust: Column, threshold: float = 0.75) -> Column:
    return F.when(trust >= threshold, "proceed_to_generation").otherwise("trigger_corrective_retrieval")
