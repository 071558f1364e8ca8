"""A part of a claim taken to pieces by rule: who, what, to whom, and with what limits."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import pairs, words
from plumbline.functions.once import once
from plumbline.session import by_value

#: How texts deny, generalise, compare, state, count, date, qualify, and whom they speak of.
NEGATION = r"(?i)\b(no|not|never|without|ineffective|does not|do not|doesn't|don't|cannot|can't)\b"
ABSOLUTE = r"(?i)\b(always|never|all|none|every|only|must)\b"
PROBABLE = r"(?i)\b(may|might|can|could|often|sometimes|typically|generally)\b"
COMPARATOR = r"(?i)\b(more than|less than|fewer than|greater than|higher than|lower than|compared to|versus|vs\.?)\b"
NUMERIC = r"\b(\d+(?:\.\d+)?)\s*(%|percent|mg|g|kg|mcg|ml|l|years?|months?|days?|hours?)?\b"
TIMEFRAME = r"(?i)\b(per day|daily|weekly|monthly|yearly|over \d+ (?:days?|weeks?|months?|years?)|in \d+ (?:days?|weeks?|months?|years?))\b"
MODALITY = r"(?i)\b(can|cannot|can't|may|might|should|must|could|would)\b"
POPULATION = r"(?i)\b(adults?|children|child|infants?|newborns?|pregnant (?:women|people)|women|men|patients?|people|humans?)\b"
PREDICATE = (
    r"\b(is|are|was|were|be|being|can|cannot|can't|could|should|must|may|might|do not|does not|don't|doesn't|treat|treats|treated|treating|prevent|prevents|prevented|preventing|cause|causes|caused|causing|"
    r"reduce|reduces|reduced|reducing|increase|increases|increased|increasing|improve|improves|improved|improving|worsen|worsens|worsened|worsening|linked to|associated with|related to|"
    r"required for|necessary for|effective for|effective against)\b"
)
#: Who recommends what; the places of the authority and of what it recommends, and the predicate.
RECOMMENDED = (
    (r"(?i)^(.+?)\s+is\s+(?:the\s+)?(?:primary|main|official|key|standard)?\s*recommendation\s+of\s+(.+)$", 2, 1, "recommends"),
    (r"(?i)^(.+?)\s+is\s+recommended\s+by\s+(.+)$", 2, 1, "recommends"),
    (r"(?i)^(.+?)\s+is\s+advised\s+by\s+(.+)$", 2, 1, "advises"),
    (r"(?i)^(.+?)\s+recommends\s+(.+)$", 1, 2, "recommends"),
    (r"(?i)^(.+?)\s+advises\s+(.+)$", 1, 2, "advises"),
)
SPLIT = r"(?is)^(.*?)" + PREDICATE + r"(.*)$"
#: What a parse is worth at least, by what it found, and its bounds.
BASE, WORTH, LEAST, MOST = 0.30, (("subject", 0.20), ("predicate", 0.25), ("object", 0.20), ("comparator", 0.05), ("numeric_value", 0.05), ("modality", 0.05)), 0.05, 0.99


def cleaned(x: Column) -> Column:
    """Single spaces, and no spaces or marks of punctuation around."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"(?U)\s+", " "), r"^[ .,:;]+|[ .,:;]+$", "")


def _authority(x: Column) -> Column:
    bare = F.trim(F.regexp_replace(cleaned(x), r"(?i)^(?:the\s+)?", ""))
    return F.trim(F.regexp_replace(bare, r"(?i)\s+(?:guidelines?|guidance|recommendations?)$", ""))


def _core(text: Column) -> Column:
    """subject, predicate, object, predicate_family."""
    made = lambda s, p, o, f: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object"), F.lit(f).alias("predicate_family"))
    got = lambda g: F.regexp_extract(text, SPLIT, g)
    core = made(cleaned(got(1)), cleaned(got(2)), cleaned(got(3)), "")
    for pattern, who, what, predicate in reversed(RECOMMENDED):
        authority, thing = _authority(F.regexp_extract(text, pattern, who)), cleaned(F.regexp_extract(text, pattern, what))
        core = F.when((authority != "") & (thing != ""), made(authority, F.lit(predicate), thing, "recommendation")).otherwise(core)
    return core


def parsed(part: Column) -> Column:
    """A struct of a part's pieces, blank where it has none, and of how much the parse is worth.

    The subject is what stands before the first predicate, without a denial or
    auxiliary at its end, or else the part's first four words; an authority is the
    subject of what it recommends.
    """

    def pieces(s: Column) -> Column:
        text, core = s["text"], s["core"]
        found = lambda p, g: F.regexp_extract(text, p, g)
        bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(core["subject"], r"(?i)\b(?:never|not|no|none|without)\b\s*$", "")), r"(?i)\b(?:has|have|had|is|are|was|were)\b\s*$", ""))
        first = cleaned(F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"\b[a-zA-Z][a-zA-Z\-]{2,}\b"), F.lit(0)), 1, 4), " "))
        subject = F.when(bare != "", bare).otherwise(first)
        kind = F.when(F.rlike(text, F.lit(ABSOLUTE)), "absolute").when(F.rlike(text, F.lit(PROBABLE)), "probabilistic").otherwise("")
        return F.struct(
            text.alias("original_text"), subject.alias("subject"), core["predicate"].alias("predicate"), core["object"].alias("object"), core["predicate_family"].alias("predicate_family"),
            F.when(F.rlike(text, F.lit(NEGATION)), "negative").otherwise("positive").alias("polarity"), kind.alias("quantifier"), cleaned(found(COMPARATOR, 1)).alias("comparator"),
            found(NUMERIC, 1).alias("numeric_value"), cleaned(found(NUMERIC, 2)).alias("unit"), cleaned(found(POPULATION, 0)).alias("population"), cleaned(found(TIMEFRAME, 0)).alias("timeframe"), cleaned(found(MODALITY, 1)).alias("modality"),
        )

    def judged(p: Column) -> Column:
        worth = F.lit(BASE)
        for name, more in WORTH:
            worth = worth + F.when(p[name] != "", more).otherwise(0.0)
        joined = cleaned(F.array_join(F.filter(F.array(p["subject"], p["predicate"], p["object"]), lambda x: x != ""), " "))
        names = ("original_text", "subject", "predicate", "object", "predicate_family", "polarity", "quantifier", "comparator", "numeric_value", "unit", "population", "timeframe", "modality")
        return F.struct(*[p[n].alias(n) for n in names], F.when(joined != "", joined).otherwise(p["original_text"]).alias("normalized_text"), F.greatest(F.lit(LEAST), F.least(F.lit(MOST), worth)).alias("parse_confidence"))

    whole = once(cleaned(part), lambda t: F.struct(t.alias("text"), _core(t).alias("core")))
    return once(once(whole, pieces), judged)


#: Shared words and entailment both ways at least, and contradiction at most, of a rewriting that is kept; what a rejected parse is worth.
KEPT_IF, REJECTED_WORTH = ((0.85, 0.50, 0.35), (0.0, 0.55, 0.20)), 0.8
#: A parse that is worth less asks for a rewriting.
ASKS_BELOW = 0.55


def guarded(original: Column, rewritten: Column, confidence: Column) -> Column:
    """A struct: whether a rewriting says what the original says, why not, both entailments, the contradiction, the text that counts and what its parse is worth.

    The same words in the same order are kept; else what each entails of the
    other, and how many words they share, must meet a row of KEPT_IF. Scores
    are rounded to nine places before they meet a threshold.
    """
    one, other = cleaned(original), cleaned(rewritten)
    plain = lambda x: F.trim(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", ""))
    tokens = lambda x: words.token_set(x, words.ALPHA)
    ways = F.struct(one.alias("o"), other.alias("r"), pairs.rule_scores(one, other).alias("there"), pairs.rule_scores(other, one).alias("back"), tokens(one).alias("ot"), tokens(other).alias("rt"))

    def measured(w: Column) -> Column:
        either = F.size(F.array_union(w["ot"], w["rt"]))
        nine = lambda x: F.round(x, 9)
        return F.struct(
            w["o"].alias("o"), w["r"].alias("r"), nine(w["there"]["entail"]).alias("there"), nine(w["back"]["entail"]).alias("back"), nine(F.greatest(w["there"]["contradict"], w["back"]["contradict"])).alias("against"),
            F.when(either > 0, nine(words.shared(w["ot"], w["rt"]) / either)).otherwise(0.0).alias("shared"),
        )

    def judged(m: Column) -> Column:
        least = F.least(m["there"], m["back"])
        fits = (plain(m["o"]) != "") & (plain(m["o"]) == plain(m["r"]))
        for common, entail, against in KEPT_IF:
            fits = fits | ((m["shared"] >= common) & (least >= entail) & (m["against"] <= against))
        blank, no_text = m["o"] == "", m["r"] == ""
        accepted = ~blank & ~no_text & fits
        reason = F.when(blank, "empty_original_segment").when(no_text, "empty_canonical_segment").when(fits, "").otherwise(F.format_string("drift_guard_failed:min_entail=%.3f,contradiction=%.3f", least, m["against"]))
        drifted = ~blank & ~no_text & ~fits
        worth = F.when(drifted, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), confidence * REJECTED_WORTH))).otherwise(confidence)
        return F.struct(
            accepted.alias("canonical_accepted"), reason.alias("canonical_rejected_reason"), F.when(blank | no_text, 0.0).otherwise(m["there"]).alias("entail_original_to_canonical"),
            F.when(blank | no_text, 0.0).otherwise(m["back"]).alias("entail_canonical_to_original"), F.when(blank | no_text, 0.0).otherwise(m["against"]).alias("contradiction_score"),
            F.when(accepted | blank, m["r"]).otherwise(m["o"]).alias("text"), worth.alias("worth"),
        )

    return once(once(ways, measured), judged)


def canonicalized(parts: DataFrame, rewrite: Callable[[DataFrame], DataFrame] | None = None, guard: bool = True) -> DataFrame:
    """``parts`` (claim_id, part, segment) taken to pieces, rewritten where that is asked for, and guarded.

    ``rewrite`` is given the parts whose parse lacks a predicate or an object, or
    is worth less than ASKS_BELOW (claim_id, part, original_text), and gives
    (claim_id, part, rewritten) for those that it can rewrite. What is kept
    without a predicate or an object is incomplete, and is not accepted.
    """
    c = F.col
    rows = by_value(parts.select("claim_id", "part", "segment"), ["segment"], lambda texts: texts.withColumn("p", parsed(c("segment")))).select("claim_id", "part", "p.*")
    asks = (c("parse_confidence") < ASKS_BELOW) | (c("predicate") == "") | (c("object") == "")
    source = F.lit("rules")
    if rewrite is not None:
        told = rewrite(rows.filter(asks).select("claim_id", "part", "original_text")).select("claim_id", "part", cleaned(c("rewritten")).alias("rewritten"))
        rows = rows.join(told, ["claim_id", "part"], "left")
        by_model = F.coalesce(c("rewritten"), F.lit("")) != ""
        rows = rows.withColumns({"normalized_text": F.when(by_model, c("rewritten")).otherwise(c("normalized_text")), "_told": by_model}).drop("rewritten")
        source = F.when(c("_told") & c("canonical_accepted"), "model").otherwise("rules")
    if guard:
        rows = by_value(rows, ["original_text", "normalized_text", "parse_confidence"], lambda texts: texts.withColumn("g", guarded(c("original_text"), c("normalized_text"), c("parse_confidence"))))
        rows = rows.withColumns({"normalized_text": c("g.text"), "parse_confidence": c("g.worth")}).select("*", "g.canonical_accepted", "g.canonical_rejected_reason", "g.entail_original_to_canonical", "g.entail_canonical_to_original", "g.contradiction_score").drop("g")
    else:
        rows = rows.withColumns({"canonical_accepted": F.lit(True), "canonical_rejected_reason": F.lit("")})
    rows = rows.withColumn("canonical_source", source)
    lacking = c("canonical_accepted") & ((c("predicate") == "") | (c("object") == ""))
    worth = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), c("parse_confidence") * REJECTED_WORTH))
    rows = rows.withColumns({
        "canonical_rejected_reason": F.when(lacking, "canonical_parse_incomplete").otherwise(c("canonical_rejected_reason")),
        "parse_confidence": F.when(lacking, worth).otherwise(c("parse_confidence")), "canonical_accepted": c("canonical_accepted") & ~lacking,
    })
    return rows.drop("_told")


def tracks(segments: DataFrame) -> DataFrame:
    """(claim_id, original, canonical): each claim's parts in order, as they stand and as rewritten where that is accepted."""
    c = F.col
    held = segments.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("part", c("original_text").alias("o"), F.when(c("canonical_accepted"), c("normalized_text")).alias("n")))).alias("s"))
    texts = lambda name: F.filter(F.transform("s", lambda x: x[name]), lambda x: x.isNotNull() & (x != ""))
    return held.select("claim_id", texts("o").alias("original"), texts("n").alias("canonical"))


#: The queries of a part by what they are after and on which track, in their order: {o} the part as it stands, {c} as rewritten, {t} its triple, {s} and {b} its subject and object.
PLAIN = (("original", "support", ("{o}", "{o} evidence", "{o} systematic review")), ("original", "refute", ("no evidence {o}", "{o} ineffective")), ("canonical", "support", ("{c}", "{c} clinical evidence")), ("canonical", "refute", ("evidence against {c}",)))
WITH_TRIPLE = {("original", "refute"): ("no evidence {t}", "{denied}"), ("canonical", "refute"): ("evidence against {t}",)}
ADVICE = {
    ("original", "support"): ("{s} recommends {b}", "{s} recommendation {b}", "{s} guidance {b}"), ("original", "refute"): ("{s} advises against {b}", "{s} does not recommend {b}"),
    ("canonical", "support"): ("{s} official recommendation {b}", "{s} healthy guidance {b}"), ("canonical", "refute"): ("evidence against {s} recommending {b}",),
}
AUTHORITIES = "{a} site:who.int OR site:cdc.gov"


def _filled(template: str, values: dict[str, Column]) -> Column:
    pieces = [F.lit(x) if i % 2 == 0 else values[x] for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
    return cleaned(F.concat(*pieces))


def _numbered(asked: Column, n: int) -> Column:
    return F.transform(asked, lambda q: F.struct(F.lit(n).alias("of"), q.alias("query")))


def part_queries(segments: DataFrame, most: int = 8) -> DataFrame:
    """(claim_id, part, place, query, track, facet): up to ``most`` queries of each part, on both tracks.

    Advice has queries of its own on both tracks, whether its rewriting is
    accepted or not. A query that both tracks have belongs to the original one,
    and to the first thing it is after.
    """
    c = F.col
    names = {"o": "original_text", "c": "normalized_text", "s": "subject", "p": "predicate", "b": "object"}
    values = {k: cleaned(c(v)) for k, v in names.items()}
    values["t"] = cleaned(F.concat_ws(" ", values["s"], values["p"], values["b"]))
    copula = values["p"].isin("is", "are", "was", "were") & (values["s"] != "") & (values["b"] != "")
    values["denied"] = F.when(copula, F.concat(values["s"], F.lit(" is not "), values["b"])).otherwise(F.concat(values["s"], F.lit(" does not "), values["p"], F.lit(" "), values["b"]))
    values["a"] = F.when(values["c"] != "", values["c"]).otherwise(values["o"])
    advice = (c("predicate_family") == "recommendation") & (values["s"] != "") & (values["b"] != "")
    none = F.array().cast("array<string>")
    every, held = [], []
    for track, facet, templates in PLAIN:
        made = F.array(*[_filled(t, values) for t in templates])
        if (track, facet) in WITH_TRIPLE:
            made = F.when(values["t"] != "", F.array(*[_filled(t, values) for t in WITH_TRIPLE[track, facet]])).otherwise(made)
        there = values["o"] != "" if track == "original" else c("canonical_accepted") & (values["c"] != "")
        made = F.when(advice, F.array(*[_filled(t, values) for t in ADVICE[track, facet]])).when(there, made).otherwise(none)
        every.append(_numbered(made, len(held)))
        held.append((track, facet))
    every.append(_numbered(F.when(values["a"] != "", F.array(_filled(AUTHORITIES, values))).otherwise(none), len(held)))
    asked = F.filter(F.slice(F.concat(*every), 1, most), lambda x: x["query"] != "")
    first = lambda a, q: F.array_min(F.transform(F.filter(a, lambda y: y["query"] == q["query"]), lambda y: y["of"]))
    kinds = [*held, ("canonical", "authoritative")]
    name = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in kinds]), (c("of") + 1).cast("int"))
    marked = once(asked, lambda a: F.transform(a, lambda q: F.struct(q["query"].alias("query"), first(a, q).alias("of"))))
    # the queries are those of a part's texts: once for each distinct row of these
    texts = [*names.values(), "predicate_family", "canonical_accepted"]
    rows = by_value(segments.select("claim_id", "part", *texts), texts, lambda values: values.withColumn("asked", marked))
    rows = rows.select("claim_id", "part", F.posexplode("asked").alias("place", "q")).select("claim_id", "part", "place", "q.query", "q.of")
    return rows.select("claim_id", "part", (c("place") + 1).alias("place"), "query", name(0).alias("track"), name(1).alias("facet"))


def claim_queries(asked: DataFrame) -> DataFrame:
    """(claim_id, original, canonical, merged): the queries of part_queries() by track, each once, those of the original track first."""
    c = F.col
    held = asked.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("part", "place", "query", "track"))).alias("q"))
    of = lambda track: F.array_distinct(F.transform(F.filter("q", lambda x: x["track"] == track), lambda x: x["query"]))
    rows = held.select("claim_id", of("original").alias("original"), of("canonical").alias("canonical"))
    return rows.select("*", F.array_distinct(F.concat("original", "canonical")).alias("merged"))
