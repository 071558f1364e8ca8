"""Token sets, phrases and marks of claims and statements, as column expressions.

Patterns see lower-cased text and take letters of all scripts for word letters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.once import once

#: Words that say nothing about a topic.
STOP = ("the", "a", "an", "and", "or", "but", "to", "for", "of", "in", "on", "with", "by", "at", "is", "are", "was", "were", "be", "been", "being")
#: Runs of word letters; with apostrophes or hyphens inside; words of three letters or more.
RUN = r"[\p{L}\p{N}_]+"
APOSTROPHE = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
HYPHEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-]*[\p{L}\p{N}_])?"
ALPHA = r"\b[a-z][a-z\-]{2,}\b"

#: Claim types of the ranker, by the first pattern that fits.
CLAIM_TYPES = (
    ("therapeutic", r"\b(treat|treatment|cure|prevent|effective|efficacy|works?)\b"),
    ("causal", r"\b(cause|causes|linked|association|risk|increase|decrease)\b"),
    ("mechanistic", r"\b(mechanism|pathway|gene|protein|receptor|cellular)\b"),
)
#: Marks of action, and the verbs that show them.
ACTIONS = (
    ("improve", r"\b(improv(?:e|es|ed|ing)|enhanc(?:e|es|ed|ing)|benefit(?:s|ed|ing)?|help(?:s|ed|ing)?|reliev(?:e|es|ed|ing)|facilitat(?:e|es|ed|ing)|alleviat(?:e|es|ed|ing)|mitigat(?:e|es|ed|ing)|heal(?:s|ed|ing)?)\b"),
    ("reduce", r"\b(reduc(?:e|es|ed|ing)|lower(?:s|ed|ing)?|decreas(?:e|es|ed|ing)|suppress(?:es|ed|ing)?)\b"),
    ("prevent", r"\b(prevent(?:s|ed|ing)?|protect(?:s|ed|ing)?|block(?:s|ed|ing)?|inhibit(?:s|ed|ing)?)\b"),
    ("cause", r"\b(caus(?:e|es|ed|ing)|trigger(?:s|ed|ing)?|increas(?:e|es|ed|ing)|induc(?:e|es|ed|ing))\b"),
    ("treat", r"\b(treat(?:s|ed|ing)?|cure(?:s|d|ing)?|manag(?:e|es|ed|ing)|administer(?:s|ed|ing)?|prescrib(?:e|es|ed|ing))\b"),
    ("diagnose", r"\b(diagnos(?:e|es|ed|ing)|detect(?:s|ed|ing)?|determin(?:e|es|ed|ing)|test(?:s|ed|ing)?|screen(?:s|ed|ing)?)\b"),
    ("harm", r"\b(disrupt(?:s|ed|ing)?|damage(?:s|d|ing)?|impair(?:s|ed|ing)?|destroy(?:s|ed|ing)?|worsen(?:s|ed|ing)?)\b"),
    ("spread", r"\b(spread(?:s|ing)?|transmit(?:s|ted|ting)?|infect(?:s|ed|ing)?)\b"),
)
#: Negation, as the ranker, the rank phase and the coverage see it.
NEGATED_RANK = r"\b(?:no|not|never|without|cannot|can't|does not|do not|did not|doesn't|don't|didn't|none)\b"
NEGATED_PHASE = r"\b(?:no|not|never|without|cannot|can't|does not|do not|did not|doesn't|don't|didn't)\b"
NEGATED_COVERAGE = r"\b(?:does\s+not|do\s+not|cannot|without|never|not|no)\b"
NEGATED_STANCE = r"\b(no|not|never|without|ineffective)\b"
NEGATED_NLI = r"\b(no|not|never|without|ineffective|doesn't|dont|do not|does not)\b"
#: A statement that refutes by its object, one that only mentions a claim, and claims about beliefs.
REFUTES_OBJECT = r"\bonly\s+(?:for|against)\b|\bdo(?:es)?\s+not\s+work\s+(?:for|against|on)\b|\bnot\s+effective\s+(?:for|against)\b|\bineffective\s+(?:for|against)\b|\bviral\b"
MENTIONS_CLAIM = r"\bmyth\b|\bmisinformation\b|\bdisinformation\b|\bconspiracy\b|\bfalse claim\b|\bunfounded\b|\bhoax\b|\brumou?r\b|\bbeliev(?:e|ed|es|ing)\s+that\b|\bperceiv(?:e|ed|es|ing)\s+that\b|\bhesitan(?:cy|t)\b|\bacceptance\b|\bsurvey\b"
BELIEF_CLAIM = r"\b(believe|belief|believed|think|thought|perceive|perceived|concern|hesitancy|acceptance|survey)\b"
ASSERTIVE = r"\b(helps?|prevents?|reduces?|increases?|causes?|proves?|protects?)\b"
#: Page furniture that no evidence may hold, and marks of doubt.
LOW_SIGNAL = ("data element definitions", "registration or results information", "javascript and cookies", "requires human verification", "enable javascript")
DOUBT = ("less certain", "uncertain", "unclear", "inconclusive", "insufficient evidence", "mixed evidence")
#: Words left out of claim overlap and of claim focus beside STOP.
OVERLAP_STOP = (*STOP, "could", "would", "should", "can", "may", "might", "about", "over", "under", "average")
FOCUS_STOP = (*STOP, "this", "that", "these", "those")
#: Where a claim's subject ends and its object begins.
DIRECTION = r"\b(?:increase|increases|increased|cause|causes|caused|reduce|reduces|reduced|prevent|prevents|prevented|has|have)\b"
OBJECT_OF = r"\b(?:against|for|on)\s+(.+)$"
#: Words that are no anchor, verbs that are no object, and cues of refutation.
NO_ANCHOR = ("do", "does", "did", "not", "no", "never", "against", "for", "on", "work", "works", "working")
VERB_HINTS = ("work", "works", "working", "treat", "treats", "treating", "prevent", "prevents", "preventing", "reduce", "reduces", "reducing", "contain", "contains", "containing", "cause", "causes", "causing", "against")
REFUTATION_CUES = ("does not", "do not", "not effective", "ineffective", "cannot", "can't", "no evidence", "doesn't", "aren't", "isn't")
#: What makes a claim one about symptoms, and what says that there are none.
SYMPTOM_PHRASES = ("noticeable symptoms", "you can tell", "you will feel", "usually has symptoms", "easy to recognize")
SYMPTOM_WORDS = r"\b(symptom|noticeable|feel|recognize|tell)\b"
NO_SYMPTOMS = ("asymptomatic", "silent", "no symptoms", "without symptoms", "often no symptoms")


def low(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def has(x: Column, pattern: str) -> Column:
    return low(x).rlike("(?U)" + pattern)


def contains_any(x: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | low(x).contains(p)
    return out


def phrase_hits(x: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases stand in the text between spaces."""
    padded = F.concat(F.lit(" "), low(x), F.lit(" "))
    out = F.lit(0)
    for p in phrases:
        out = out + padded.contains(f" {p} ").cast("int")
    return out


def found(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(low(x), F.lit("(?U)" + pattern), F.lit(0))


def token_set(x: Column, pattern: str, stop: Sequence[str] = (), longer_than: int = 0) -> Column:
    """Distinct tokens, first come first, that are no stop words and have more letters."""
    out = F.array_except(found(x, pattern), F.array(*[F.lit(s) for s in stop]).cast("array<string>"))
    return F.filter(out, lambda w: F.length(w) > longer_than) if longer_than else out


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def claim_type(x: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in CLAIM_TYPES:
        out = out.when(has(x, pattern), name)
    return out.otherwise("general")


def forms(pattern: str) -> tuple[str, ...]:
    """The words that a pattern of ACTIONS stands for: stems, each with its endings."""
    out = []
    for stem, ends, bare in re.findall(r"([a-z]+)(?:\(\?:([a-z|]+)\)(\??))?", pattern.removeprefix(r"\b(").removesuffix(r")\b")):
        out += [stem + e for e in ends.split("|")] + ([stem] if bare else [])
    return tuple(out)


def actions(x: Column) -> Column:
    """The marks of action that a text shows, by its words: one pass over the text for all of them."""
    listed = [(name, F.array(*[F.lit(w) for w in forms(pattern)])) for name, pattern in ACTIONS]
    return once(found(x, r"\w+"), lambda t: F.array_compact(F.array(*[F.when(F.arrays_overlap(t, words), name) for name, words in listed])))


def object_tokens(x: Column) -> Column:
    """Tokens after the first against, for or on."""
    return token_set(F.regexp_extract(low(x), "(?U)" + OBJECT_OF, 1), APOSTROPHE, STOP, 2)


def direction_tokens(x: Column) -> tuple[Column, Column]:
    """Tokens before and after the verb of a directional claim; empty where there is none."""
    text = F.trim(low(x))
    both = rf"(?U)^(.+?){DIRECTION}(.+)$"
    stop = (*STOP, "risk")
    return token_set(F.regexp_extract(text, both, 1), APOSTROPHE, stop, 2), token_set(F.regexp_extract(text, both, 2), APOSTROPHE, stop, 2)


def word_share(own: Column, statement: Column) -> Column:
    """Share of a claim's own words (RUN, without OVERLAP_STOP) that the statement has."""
    return once(shared(own, token_set(statement, RUN, OVERLAP_STOP)), lambda n: F.when(F.size(own) == 0, 0.0).otherwise(n / F.size(own)))


def clean_entities(entities: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.coalesce(entities, F.array().cast("array<string>")), lambda e: F.coalesce(e, F.lit("")) != ""), lambda e: F.lower(F.trim(e))))


def entity_words(entities: Column) -> Column:
    return token_set(F.array_join(F.coalesce(entities, F.array().cast("array<string>")), " \n "), ALPHA, STOP)


def share_of_entities(asked: Column, asked_words: Column, own: Column, own_words: Column) -> Column:
    """The larger of the shares of asked entities (clean_entities) and of their words (entity_words) that the own ones hold."""
    exact = shared(asked, own) / F.size(asked)
    by_word = F.when((F.size(asked_words) == 0) | (F.size(own_words) == 0), exact).otherwise(F.greatest(exact, shared(asked_words, own_words) / F.size(asked_words)))
    return F.when((F.size(asked) == 0) | (F.size(own) == 0), 0.0).otherwise(by_word)


def entity_share(asked: Column, asked_words: Column, own: Column) -> Column:
    """share_of_entities() of entities as they are given."""
    return once(F.struct(clean_entities(own).alias("i"), entity_words(own).alias("t")), lambda x: share_of_entities(asked, asked_words, x["i"], x["t"]))


def strip_negation(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(low(x), "(?U)" + NEGATED_COVERAGE, " "), r"(?U)\s+", " "))


def anchor_terms(x: Column, most: int = 4) -> Column:
    """Up to ``most`` words that evidence on the claim should hold: its own, then those of its object."""
    own = token_set(strip_negation(x), HYPHEN, STOP)
    of = token_set(F.regexp_extract(low(x), "(?U)" + OBJECT_OF, 1), HYPHEN, STOP)
    every = F.array_except(F.concat(own, of), F.array(*[F.lit(w) for w in NO_ANCHOR]))
    return F.slice(F.filter(every, lambda w: F.length(w) >= 3), 1, most)


def spaced(x: Column) -> Column:
    """Lower-cased text with every sign between spaces, so that a word in it is found between spaces."""
    return F.concat(F.lit(" "), F.regexp_replace(low(x), r"(?U)([^\p{L}\p{N}_])", " $1 "), F.lit(" "))


def anchor_hits(anchors: Column, statement: Column) -> Column:
    """How many anchors the statement holds; phrases as they stand, words between word boundaries."""
    words, text = spaced(statement), low(statement)
    inside = lambda a: F.when(F.contains(a, F.lit(" ")), F.contains(text, a)).otherwise(F.contains(words, spaced(a)))
    return F.size(F.filter(anchors, lambda a: (a != "") & inside(a)))


def anchor_marks(anchors: Column) -> Column:
    """Anchors as marked_hits() takes them, blank ones left out."""
    return F.transform(F.filter(anchors, lambda a: a != ""), lambda a: F.struct(a.alias("a"), F.when(~F.contains(a, F.lit(" ")), spaced(a)).alias("m")))


def marked_hits(marks: Column, text: Column, between: Column) -> Column:
    """anchor_hits() of anchor_marks(), from a statement's low() and spaced() form that are worked out once for all anchors."""
    return F.size(F.filter(marks, lambda x: F.when(x["m"].isNull(), F.contains(text, x["a"])).otherwise(F.contains(between, x["m"]))))


def about_symptoms(claim: Column) -> Column:
    return (phrase_hits(claim, SYMPTOM_PHRASES) > 0) | has(claim, SYMPTOM_WORDS)


def negation_anchor(about: Column, statement: Column, anchor_share: Column) -> Column:
    """How far a statement of missing symptoms meets a claim that is about symptoms."""
    return F.when(about & (phrase_hits(statement, NO_SYMPTOMS) > 0), 0.50 + 0.50 * anchor_share).otherwise(0.0)


def source_quality(url: Column, doc_type: Column, statement: Column) -> Column:
    strong = contains_any(statement, ("systematic review", "meta-analysis", "randomized"))
    kind = low(doc_type)
    base = (
        F.when(kind == "guideline", 0.95).when((kind == "journal") & strong, 0.93).when(kind == "journal", 0.88).when(kind == "report", 0.80)
        .when(kind.isin("web", "encyclopedia"), 0.60).when(kind == "news", 0.45).otherwise(0.5)
    )
    base = F.when(low(url).contains("cochrane"), F.greatest(base, F.lit(0.95))).otherwise(base)
    return F.when(contains_any(url, ("pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov")), F.greatest(base, F.lit(0.88))).otherwise(base)
