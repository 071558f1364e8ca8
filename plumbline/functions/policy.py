"""How strict a claim is, how strong a statement, and whether either belongs here at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import words
from plumbline.functions.scoring import clamp01
from plumbline.functions.words import low, phrase_hits

#: Marks of claims.
UNIVERSAL = ("all", "every", "entirely", "completely", "always", "never", "none", "without exception")
BROAD = ("typically", "generally", "usually", "most", "majority")
TENTATIVE = ("may", "might", "can", "could", "possible", "possibly", "potentially", "associated with", "linked to")
DEFINITIVE = ("proves", "proven", "definitely", "certainly", "guaranteed")
CAUSAL = ("causes", "results in", "leads to", "drives", "induces", "prevents", "cures", "eliminates", "reverses")
COMPARATIVE = ("higher than", "lower than", "more than", "less than", "compared to", "versus", "vs")
CONDITIONAL = ("if", "when", "under", "depending on", "provided that", "in some cases", "for some people")
#: Marks of evidence.
HEDGES = ("may", "might", "could", "suggests", "suggested", "possibly", "appears to", "potentially", "is associated with", "correlates with")
UNCERTAIN = ("uncertain", "inconclusive", "mixed evidence", "insufficient evidence", "more research is needed", "not well established")
RARE = ("rare", "rarely", "in rare cases", "isolated case", "case report")
CONDITIONS = ("under certain conditions", "depending on", "if", "when", "can occur in")
NARROW = ("in vitro", "in mice", "animal model", "cell line", "preclinical")
FIRM = ("demonstrated", "confirmed", "meta-analysis", "systematic review", "randomized trial")
#: Patterns whose hits are counted or looked for.
NUMBER = r"\b\d+(\.\d+)?\b"
UNIT = r"\b(mg|g|kg|ml|%|ratio|odds)\b"
CLAIM_NEGATED = r"\b(no|not|never|without|none)\b"
TEXT_NEGATED = r"\b(no|not|never|without|none|does not|cannot|can't)\b"
STRENGTH_STOP = (*words.STOP, "that", "this")
STRENGTH_TOKEN = r"\b[a-z][a-z0-9_-]{2,}\b"
#: What says that a page could not be read.
BLOCKED = r"\baccess denied\b|\bdenied access\b|\bpermission required\b|\bforbidden\b|\b403\b|\bcaptcha\b|\bblocked\b|\btemporarily unavailable\b"
#: Weights of what makes a claim a medical one.
HEALTH = (
    (r"\b(clinical|trial|cohort|case-control|randomized|placebo|double-blind)\b", 0.18),
    (r"\b(patient|participants?|subjects?|population|outcome|endpoint)\b", 0.15),
    (r"\b(dos(?:e|age)|mg|mcg|g/day|per day|frequency|administration)\b", 0.12),
    (r"\b(biomarker|pathway|protein|gene|cellular|receptor|enzyme)\b", 0.12),
    (r"\b(symptom|diagnos(?:is|e)|treat(?:ment|ing)?|prevent(?:ion|ive)?|risk)\b", 0.16),
    (r"\b(incidence|prevalence|mortality|morbidity|hazard ratio|odds ratio)\b", 0.14),
    (r"\b(pubmed|pmc|guideline|systematic review|meta-analysis)\b", 0.13),
)
#: Evidence that something works, and evidence on safety alone.
EFFICACY = r"\bcure(s|d)?\b|\btreat(s|ed|ment)?\b|\befficacy\b|\btherap(y|eutic)\b|\bclinical trial\b|\brandomi[sz]ed\b|\bimprove(s|d)? survival\b|\bremission\b"
#: What a count claim counts, and how numbers are written.
COUNTED = ("bones", "bone", "beats", "beat", "cells", "cell", "cases", "case", "times", "bpm", "count")
COUNT_NUMBER = r"\b\d{1,3}(?:,\d{3})*(?:\.\d+)?\b"
#: Relevance labels that support and that refute.
SUPPORTS = ("SUPPORTS", "VALID", "PARTIALLY_VALID", "PARTIALLY_SUPPORTS")
REFUTES = ("REFUTES", "CONTRADICTS", "INVALID", "PARTIALLY_INVALID", "PARTIALLY_CONTRADICTS")


def regex_hits(x: Column, pattern: str) -> Column:
    return F.regexp_count(low(x), F.lit("(?U)" + pattern))


def strictness(claim: Column) -> Column:
    """A struct: assertiveness, universality, modality, falsifiability, claim_type, level, is_conditional, is_multi_step, symptom_inference."""
    x = F.trim(F.coalesce(claim, F.lit("")))
    universal, broad, tentative, definitive, causal, comparative, conditional = (phrase_hits(x, p) for p in (UNIVERSAL, BROAD, TENTATIVE, DEFINITIVE, CAUSAL, COMPARATIVE, CONDITIONAL))
    numeric = regex_hits(x, NUMBER) + regex_hits(x, UNIT)
    assertive = clamp01((1.3 * universal + 0.9 * definitive + 0.7 * causal + 0.4 * broad) / 4.0)
    scope = clamp01((1.2 * universal + 0.6 * broad) / 2.0)
    modality = clamp01((1.0 + 0.8 * definitive + 0.7 * universal - 0.8 * tentative - 0.6 * conditional) / 2.0)
    testable = clamp01((0.9 * numeric + 0.8 * comparative + 0.6 * causal + 0.4 * universal) / 3.0)
    testable = F.when((numeric > 0) | (comparative > 0), clamp01(testable + 0.08)).otherwise(testable)
    kind = (
        F.when((regex_hits(x, NUMBER) > 0) | F.contains(x, F.lit("%")), "NUMERIC").when(comparative > 0, "COMPARATIVE")
        .when((causal > 0) & words.has(x, r"\b(risk|odds|likelihood|probability)\b"), "RISK_ASSOCIATION")
        .when((causal > 0) & words.has(x, r"\b(cure|prevent|eliminate|treat|reverse)\b"), "PREVENTION_TREATMENT").when(causal > 0, "CAUSAL").otherwise("FACTUAL")
    )
    index = clamp01(0.40 * assertive + 0.30 * scope + 0.30 * modality)
    index = F.round(F.when(kind.isin("CAUSAL", "PREVENTION_TREATMENT", "NUMERIC", "COMPARATIVE"), clamp01(index + 0.08)).otherwise(index), 9)
    level = F.when(index >= 0.82, "VERY_HIGH").when(index >= 0.70, "HIGH").when(index >= 0.52, "MEDIUM").otherwise("LOW")
    steps = words.has(x, r"\b(and|then|therefore|through|via)\b") & words.has(x, "[,.;:]")
    return F.struct(
        F.round(assertive, 4).alias("assertiveness"), F.round(scope, 4).alias("universality"), F.round(modality, 4).alias("modality"), F.round(testable, 4).alias("falsifiability"), kind.alias("claim_type"), level.alias("level"),
        ((conditional > 0) | words.has(x, r"\b(if|when|unless|depending)\b")).alias("is_conditional"), steps.alias("is_multi_step"), F.round(clamp01(phrase_hits(x, words.SYMPTOM_PHRASES) / 2.0), 4).alias("symptom_inference"),
    )


def strength(claim: Column, text: Column, credibility: Column, hint: Column) -> Column:
    """A struct: support, hedge, rarity, quality, stance, negation_anchor of a statement towards a claim."""
    hedge = clamp01((0.55 * phrase_hits(text, HEDGES) + 0.35 * phrase_hits(text, UNCERTAIN) + 0.25 * phrase_hits(text, CONDITIONS)) / 2.0)
    rarity = clamp01((0.65 * phrase_hits(text, RARE) + 0.35 * phrase_hits(text, NARROW)) / 2.0)
    given = F.when(F.coalesce(credibility, F.lit(0.0)) == 0, 0.5).otherwise(credibility)
    quality = clamp01(0.70 * given + 0.30 * clamp01(phrase_hits(text, FIRM) / 2.0))
    own, other = words.token_set(claim, STRENGTH_TOKEN, STRENGTH_STOP), words.token_set(text, STRENGTH_TOKEN, STRENGTH_STOP)
    over = F.when(F.size(own) > 0, words.shared(own, other) / F.size(own)).otherwise(0.0)
    anchors = words.anchor_terms(claim)
    share = F.when(F.size(anchors) > 0, words.anchor_hits(anchors, text) / F.size(anchors)).otherwise(0.0)
    base = 0.45 * over + 0.35 * share + 0.20 * quality
    said = F.upper(F.coalesce(hint, F.lit("")))
    by_words = F.when(words.has(claim, CLAIM_NEGATED) == words.has(text, TEXT_NEGATED), "SUPPORTS").otherwise("REFUTES")
    stance = F.when(said.isin("CONTRADICTS", "REFUTES", "INVALID", "PARTIALLY_INVALID"), "REFUTES").when(said.isin("SUPPORTS", "VALID", "PARTIALLY_VALID", "ENTAILS"), "SUPPORTS").otherwise(by_words)
    return F.struct(
        F.round(clamp01(base - 0.55 * hedge - 0.45 * rarity), 4).alias("support"), F.round(hedge, 4).alias("hedge"), F.round(rarity, 4).alias("rarity"), F.round(quality, 4).alias("quality"), stance.alias("stance"),
        F.round(words.negation_anchor(words.about_symptoms(claim), text, share), 4).alias("negation_anchor"),
    )


def health_scope(claim: Column, declared: Column) -> Column:
    """A struct: in_scope, confidence, reason."""
    score = F.lit(0.0)
    for pattern, weight in HEALTH:
        score = score + F.when(words.has(claim, pattern), weight).otherwise(0.0)
    said = F.trim(low(declared))
    score = score + F.when(said.isin("health", "biomedical", "medicine"), 0.10).when((said != "") & ~said.isin("general", "unknown"), -0.05).otherwise(0.0)
    empty = F.trim(low(claim)) == ""
    sure = F.round(F.when(empty, 0.0).otherwise(clamp01(score)), 9)
    inside = ~empty & (sure >= 0.45)
    reason = F.when(empty, "empty_claim").when(inside, "health_scope_detected").otherwise("insufficient_health_scope_signal")
    return F.struct(inside.alias("in_scope"), F.round(sure, 4).alias("confidence"), reason.alias("reason"))


def blocked(statement: Column) -> Column:
    return words.has(statement, BLOCKED)


def efficacy_relevant(text: Column) -> Column:
    """Speaks of whether something works; what speaks of safety alone does not."""
    return words.has(text, EFFICACY)


def is_count_claim(claim: Column) -> Column:
    return words.has(claim, r"\bhow many\b|\bnumber of\b") | (words.has(claim, COUNT_NUMBER) & words.contains_any(claim, COUNTED))


def relevance_label(x: Column) -> Column:
    label = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return F.when(label.isin(*SUPPORTS), "SUPPORTS").when(label.isin(*REFUTES), "REFUTES").otherwise("NEUTRAL")


def inadmissible_reason(is_blocked: Column, statement: Column, on_topic: Column, on_claim: Column, predicate_match: Column, least: float = 0.15) -> Column:
    """The first gate that evidence fails, or 'ok'."""
    return (
        F.when(F.coalesce(is_blocked, F.lit(False)), "blocked_content").when(F.coalesce(statement, F.lit("")) == "", "empty_statement").when(~on_topic, "topic_guard").when(~on_claim, "claim_guard")
        .when(F.coalesce(predicate_match, F.lit(0.0)) < least, "predicate_guard").otherwise("ok")
    )


def topic_aligned(statement: Column, claim: Column, entities: Column, predicate_match: Column, target_overlap: Column, claim_overlap: Column, anchor_match: Column) -> Column:
    """The statement shares an entity and some words with the claim, or a word and its verb or object."""
    own = words.token_set(statement, words.ALPHA, words.STOP)
    names = words.token_set(F.array_join(F.coalesce(entities, F.array().cast("array<string>")), " \n "), words.ALPHA, words.STOP)
    by_entity = F.arrays_overlap(own, names) & ((claim_overlap >= 0.10) | (anchor_match >= 0.15))
    by_word = F.arrays_overlap(own, words.token_set(claim, words.ALPHA, words.STOP)) & ((predicate_match >= 0.20) | (target_overlap >= 1))
    return by_entity | by_word


def family_mismatch(statement: Column, claim: Column, entities: Column) -> Column:
    """Both name vitamins, and none in common."""
    which = lambda x: F.array_distinct(F.regexp_extract_all(low(x), F.lit(r"\bvitamin\s+([a-z0-9]+)\b"), F.lit(1)))
    asked = which(F.concat_ws(" ", F.coalesce(claim, F.lit("")), F.array_join(F.coalesce(entities, F.array().cast("array<string>")), " ")))
    own = which(statement)
    return (F.size(asked) > 0) & (F.size(own) > 0) & ~F.arrays_overlap(asked, own)


def alias_overlap(statement: Column, aliases: Column) -> Column:
    """The largest share of an alias's words that the statement has."""
    own = words.token_set(statement, words.ALPHA, words.STOP)
    share = lambda a: F.transform(F.array(words.token_set(a, words.ALPHA, words.STOP)), lambda t: F.when(F.size(t) > 0, words.shared(own, t) / F.size(t)).otherwise(0.0))[0]
    return F.coalesce(F.array_max(F.transform(aliases, share)), F.lit(0.0))


#: Single words too common to be an entity that evidence must have.
GENERIC = ("health", "healthy", "immune", "immunity", "vitamin", "supplement", "supplements", "disease", "condition")


def has_must_have(statement: Column, aliases: Column) -> Column:
    """The statement has all words of an alias; single generic words do not count, and no aliases ask for nothing."""
    own = words.token_set(statement, words.ALPHA, words.STOP)

    def met(alias: Column) -> Column:
        whole = lambda t: (F.size(t) > 0) & ~((F.size(t) == 1) & F.get(t, F.lit(0)).isin(*GENERIC)) & (words.shared(own, t) == F.size(t))
        return F.transform(F.array(words.token_set(alias, words.ALPHA, words.STOP)), whole)[0]

    return F.when(F.size(F.coalesce(aliases, F.array().cast("array<string>"))) == 0, True).otherwise(F.exists(aliases, met))


def neutral_graph_damping(stance: Column, sem: Column, kg: Column, claim_overlap: Column, anchor_match: Column, predicate_match: Column) -> Column:
    """What graph statements lose that neither contradict nor meet the claim."""
    loose = (claim_overlap < 0.30) & (anchor_match < 0.40) & (predicate_match < 0.35)
    return F.when((F.coalesce(stance, F.lit("neutral")) != "contradicts") & (sem <= 0.08) & (kg >= 0.75) & loose, 0.15).otherwise(0.0)


def therapeutic_verdict(high_support: Column, high_contra: Column, noncurative: Column, any_relevant: Column) -> Column:
    """A struct: verdict and reason from counts of high-grade and of relevant evidence."""
    relevant = (noncurative >= 1) | (any_relevant >= 1)
    verdict = F.when(high_contra >= 1, "FALSE").when(high_support >= 1, "TRUE").when(relevant, "MISLEADING").otherwise("UNVERIFIABLE")
    reason = F.when(high_contra >= 1, "high_grade_contradiction").when(high_support >= 1, "high_grade_support").when(relevant, "noncurative_relevant_evidence").otherwise("no_relevant_evidence")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"))


def fallback_verdict(claim: Column) -> Column:
    """A struct: verdict, confidence, truthfulness by the claim's words alone."""
    #: What a claim sounds like.
    rules: Sequence[tuple[tuple[str, ...], str, float, float]] = (
        (("hoax", "fake", "myth"), "FALSE", 0.86, 22.0),
        (("significantly", "guaranteed", "always", "never", "detoxifies"), "FALSE", 0.64, 38.0),
        (("improves", "supports", "is linked to", "can reduce"), "TRUE", 0.71, 63.0),
    )
    out = [F.when(F.lit(False), None)] * 3
    for phrases, *values in rules:
        out = [o.when(words.contains_any(claim, phrases), v) for o, v in zip(out, values, strict=True)]
    return F.struct(*[o.otherwise(v).alias(n) for o, v, n in zip(out, ("FALSE", 0.58, 40.0), ("verdict", "confidence", "truthfulness"), strict=True)])
