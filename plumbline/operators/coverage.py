"""How far the evidence of a claim covers its parts, and whether that is enough.

Parts: claim_id, part (1, 2, ..), subclaim, anchors (null: its own words).
Evidence: claim_id, evidence_id, statement, semantic_score, trust, stance,
candidate_type. The join on claim_id pairs each part with its own claim's
evidence only, and one aggregate picks the best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import urls, words
from plumbline.functions.scoring import clamp01
from plumbline.operators.verdict import sufficiency_rule
from plumbline.session import by_value, cut, written

#: Anchors that evidence must hold, weights of the vector score and of missing anchors, and what is strong and partial.
MIN_HITS, SEM_WEIGHT, KG_WEIGHT, STRONG, PARTIAL, PARTIAL_WEIGHT = 2, 0.70, 0.30, 0.55, 0.30, 0.5


def objects(x: Column) -> Column:
    return words.token_set(x, words.HYPHEN, (*words.STOP, *words.VERB_HINTS), 3)


def part_terms() -> Column:
    """The anchors that a part is given, else those of its words."""
    s = F.col("subclaim")
    given = F.filter(F.coalesce("anchors", F.array().cast("array<string>")), lambda a: a.isNotNull())
    given = F.transform(given, lambda a: F.trim(F.lower(a)))
    own = F.coalesce(F.when(F.size(given) > 0, given), words.anchor_terms(s))
    few = F.slice(F.filter(words.token_set(s, words.HYPHEN, words.STOP), lambda w: F.length(w) >= 3), 1, MIN_HITS)
    return F.when(F.size(own) > 0, own).otherwise(few)


def row_signals(evidence: DataFrame) -> DataFrame:
    """What the coverage needs to know of each row of evidence beside its words."""
    return evidence.withColumns({
        "semantic": clamp01(F.greatest(F.coalesce("semantic_score", F.lit(0.0)), F.coalesce("trust", F.lit(0.0)))),
        "opposes": F.lower(F.coalesce("stance", F.lit("neutral"))) == "contradicts", "is_kg": F.upper(F.coalesce("candidate_type", F.lit(""))) == "KG",
    })


def text_signals(texts: DataFrame) -> DataFrame:
    """texts (subclaim, anchors, statement) with what a statement has of a part: n_terms, hits, lexical, object_match, has_objects, cue, negation_differs, aligned."""
    c = F.col
    plain = lambda x: words.token_set(words.strip_negation(c(x)), words.HYPHEN, words.STOP)
    own = lambda x: words.token_set(c(x), words.HYPHEN, words.STOP)
    # written step by step, so that no later expression works a text out again
    rows = written(texts.withColumn("terms", part_terms()))
    rows = written(rows.withColumns({
        "marks": words.anchor_marks(c("terms")), "row_low": words.low(c("statement")), "row_spaced": words.spaced(c("statement")), "part_tokens": own("subclaim"), "row_tokens": own("statement"), "part_plain": plain("subclaim"), "row_plain": plain("statement"),
        "part_objects": objects(c("subclaim")), "row_objects": objects(c("statement")), "cue": words.contains_any(c("statement"), words.REFUTATION_CUES),
        "negation_differs": words.has(c("subclaim"), words.NEGATED_COVERAGE) != words.has(c("statement"), words.NEGATED_COVERAGE),
    }))
    rows = rows.withColumn("_common", words.shared(c("part_plain"), c("row_plain")))
    aligned = (c("_common") >= 2) | ((c("_common") > 0) & (c("_common") / F.greatest(F.lit(1), F.size("part_plain")) >= 0.50))
    return rows.select(
        *texts.columns, F.size("terms").alias("n_terms"), words.marked_hits(c("marks"), c("row_low"), c("row_spaced")).alias("hits"), (words.shared(c("part_tokens"), c("row_tokens")) / F.greatest(F.lit(1), F.size("part_tokens"))).alias("lexical"),
        F.arrays_overlap("part_objects", "row_objects").alias("object_match"), (F.size("part_objects") > 0).alias("has_objects"), "cue", "negation_differs", aligned.alias("aligned"),
    )


def relevance(pairs: DataFrame) -> DataFrame:
    """Parts joined with row_signals(), with the relevance of each pair and what its status depends on."""
    c = F.col
    rows = by_value(pairs, ["subclaim", "anchors", "statement"], text_signals)
    by_anchor = F.when(c("n_terms") > 0, c("hits") / c("n_terms")).otherwise(0.0)
    over = F.greatest(c("lexical"), by_anchor)
    x = F.greatest(SEM_WEIGHT * c("semantic") + (1 - SEM_WEIGHT) * F.least(F.lit(1.0), c("hits") / MIN_HITS), 0.60 * c("semantic") + 0.40 * over)
    off = c("has_objects") & ~c("object_match") & (c("semantic") >= 0.75) & ~c("cue")
    x = F.when(c("object_match") & (c("semantic") >= 0.65), F.least(F.lit(1.0), x + 0.08)).when(off, 0.85 * x).otherwise(x)
    x = x * F.when(~c("is_kg"), 1.0).when(c("hits") == 0, 1 - KG_WEIGHT).when(c("hits") < MIN_HITS, 0.85).otherwise(1.0)
    x = x * F.when(c("opposes"), 0.30).otherwise(1.0)
    return rows.withColumns({"overlap": over, "relevance": F.round(clamp01(x), 9), "semantic": F.round("semantic", 9)})


def covered(parts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per part: its best evidence, status, weight and figures. Ties go to the smaller evidence_id.

    A part without evidence of any relevance takes the one with the best vector
    score, where that is partial at least; else it stays UNKNOWN.
    """
    c = F.col
    asked = parts.filter(F.trim(F.coalesce("subclaim", F.lit(""))) != "").select("claim_id", "part", "subclaim", "anchors")
    own = evidence.select("claim_id", "evidence_id", "statement", "semantic_score", "trust", "stance", "candidate_type", *[(c(x) if x in evidence.columns else F.lit(None)).cast("double").alias(x) for x in ("predicate_match", "target_overlap")])
    pairs = relevance(asked.join(row_signals(own), "claim_id"))
    asked = by_value(asked, ["subclaim", "anchors"], lambda texts: texts.withColumn("terms", part_terms()))
    row = F.struct("evidence_id", "relevance", "semantic", "overlap", "lexical", "hits", "object_match", "cue", "negation_differs", "aligned", "opposes", "is_kg", "trust", "predicate_match", "target_overlap")
    by_relevance = F.max_by(row, F.when(c("relevance") > 0, F.struct("relevance", -c("evidence_id"))))
    by_vector = F.max_by(row, F.when(c("semantic") >= PARTIAL, F.struct("semantic", -c("evidence_id"))))
    best = pairs.groupBy("claim_id", "part").agg(F.coalesce(by_relevance, by_vector).alias("b"))
    rows = asked.select("claim_id", "part", "subclaim", "terms").join(best, ["claim_id", "part"], "left")
    no = lambda x: F.coalesce(c(f"b.{x}"), F.lit(False))
    semantic, hits = F.coalesce("b.semantic", F.lit(0.0)), F.coalesce("b.hits", F.lit(0))
    scope = no("object_match") | no("cue")
    denied = (semantic >= 0.80) & no("negation_differs") & scope & (no("aligned") | (hits >= 1))
    opposed = no("opposes") & scope
    status = (
        F.when(denied, "INVALID").when(opposed, "UNKNOWN")
        .when((semantic >= STRONG) & ((hits >= MIN_HITS) | (no("object_match") & (semantic >= 0.80))), "STRONGLY_VALID")
        .when((semantic >= PARTIAL) & ((hits >= 1) | no("object_match")), "PARTIALLY_VALID").otherwise("UNKNOWN")
    )
    rows = rows.withColumn("status", status)
    return rows.select(
        "claim_id", "part", "subclaim", "status", F.when(c("status") == "STRONGLY_VALID", 1.0).when(c("status") == "PARTIALLY_VALID", PARTIAL_WEIGHT).otherwise(0.0).alias("weight"),
        F.coalesce("b.evidence_id", F.lit(-1)).cast("long").alias("evidence_id"), F.coalesce("b.relevance", F.lit(0.0)).alias("relevance"), semantic.alias("semantic"),
        F.coalesce("b.overlap", F.lit(0.0)).alias("overlap"), hits.cast("long").alias("anchors_matched"), F.size("terms").cast("long").alias("n_anchors"),
        (denied | opposed).alias("contradicted"), F.coalesce("b.trust", F.lit(0.0)).alias("best_trust"), c("b.predicate_match").alias("predicate_match"), c("b.target_overlap").alias("target_overlap"),
    )


def coverage(details: DataFrame) -> DataFrame:
    """(claim_id, parts, weighted, coverage) of covered() rows."""
    agg = details.groupBy("claim_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("weight").alias("weighted"))
    return agg.withColumn("coverage", clamp01(F.col("weighted") / F.col("parts")))


def adaptive_trust(parts: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per claim with parts: coverage, diversity, agreement, trust, whether that is enough, why, and the state of the verdict.

    ``evidence`` are the ranked first rows of each claim. Those marked
    inadmissible or off topic (columns admissible, on_topic) are left out where
    others remain.
    """
    c = F.col
    good = F.coalesce("on_topic", F.lit(True)) & F.coalesce("admissible", c("on_topic"), F.lit(True))
    some = F.max(good).over(Window.partitionBy("claim_id"))
    top = cut(evidence.withColumn("_some", some).filter(good | ~c("_some")).drop("_some"))
    details = covered(parts, top)
    host = F.coalesce(urls.domain(c("source_url")), F.lit(""))
    seen = top.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("used"), F.size(F.collect_set(host)).alias("hosts"), F.avg(F.when(c("stance") != "contradicts", 1.0).otherwise(0.0)).alias("agreement"),
        F.max("semantic_score").alias("top_sem"), F.max("trust").alias("top_trust"),
    )
    paid = (c("weight") > 0) & (c("best_trust") > 0)
    agg = details.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("parts"), (F.sum("weight") / F.count(F.lit(1))).alias("coverage"), F.count_if(c("status") == "STRONGLY_VALID").alias("strong"),
        F.count_if("contradicted").alias("contradicted"), F.avg("relevance").alias("relevance"), F.avg(F.when(paid, c("best_trust") * c("weight"))).alias("paid"),
        F.avg("predicate_match").alias("predicate"), F.avg((c("target_overlap") > 0).cast("double")).alias("target"),
    )
    rows = agg.join(seen, "claim_id", "left").fillna({"used": 0, "hosts": 0, "agreement": 0.0, "top_sem": 0.0, "top_trust": 0.0})
    n, u = c("used"), c("hosts")
    rows = rows.withColumns({
        "diversity": F.when(n <= 1, 0.0).when(u >= n, 1.0).otherwise(clamp01(1 - F.log(n / u) / u)),
        "relevance": F.when(c("contradicted") > 0, F.greatest(F.lit(0.0), c("relevance") - 0.10 * c("contradicted") / c("parts"))).otherwise(c("relevance")),
    })
    rows = rows.withColumns({x: F.round(x, 9) for x in ("diversity", "relevance", "coverage", "agreement")})
    rule = sufficiency_rule(c("coverage"), c("diversity"), c("agreement"), n, c("relevance"), c("strong"), c("contradicted"))
    override = (c("contradicted") == 0) & (c("strong") > 0) & (n >= 2) & (((c("coverage") >= 0.35) & (c("diversity") >= 0.75)) | (c("relevance") >= 0.60))
    post = F.coalesce(c("paid") * (0.5 + 0.5 * c("coverage")), c("top_trust") * F.greatest(F.lit(0.25), c("coverage")))
    post = F.when(n == 0, 0.0).when((post <= 0) & (c("coverage") >= 0.5) & (c("top_trust") > 0), c("top_trust") * c("coverage")).otherwise(post)
    rows = rows.withColumns({"rule": rule, "override": override, "trust_post": F.round(post, 9)})
    # where the best evidence was matched with the claim's verb and object, both must fit
    unfit = (c("predicate").isNotNull() | c("target").isNotNull()) & (c("contradicted") == 0) & ((F.coalesce("predicate", F.lit(0.0)) < 0.10) | (F.coalesce("target", F.lit(0.0)) < 0.20))
    rows = rows.withColumn("unfit", unfit & ~c("rule").startswith("fail")).withColumn("passed", ~c("rule").startswith("fail") & ~c("unfit"))
    guarded = c("override") & ~c("unfit") & (c("coverage") >= 0.65) & (c("relevance") >= 0.68) & (c("top_trust") >= 0.58)
    settled = (c("coverage") >= 0.95) & (c("agreement") >= 0.9)
    weak = c("passed") & ((~guarded & ~settled & (c("contradicted") == 0) & ((c("trust_post") < 0.40) | (c("top_sem") < 0.45) | (c("top_trust") < 0.40))) | (c("top_trust") < 0.15))
    state = F.when(~c("passed") | weak, "evidence_insufficiency").when(c("trust_post") >= 0.8, "confirmed").when(c("trust_post") >= 0.6, "provisional").otherwise("revoked")
    reason = F.when(weak, "weak_relevance_guard").when(c("unfit"), "predicate_object_guard").when(c("override"), "adaptive_override").when(c("contradicted") > 0, "strict_contradiction").otherwise("strict")
    return rows.select("claim_id", "parts", "coverage", "diversity", "agreement", "strong", "contradicted", "relevance", "trust_post", (c("passed") & ~weak).alias("enough"), "rule", reason.alias("reason"), state.alias("state"))


def covers(subclaim: Column, statement: Column, score: Column) -> Column:
    """Two shared words at least, that make 18 per cent of the part's, and a score of 0.38."""
    a, b = (words.token_set(x, words.RUN, (*words.STOP, "could", "would", "should", "can")) for x in (subclaim, statement))
    common = words.shared(a, b)
    return (common >= 2) & (common / F.greatest(F.lit(1), F.size(a)) >= 0.18) & (score >= 0.38)


#: Words that carry no content beside STOP, denials, and statements that only mention a claim.
MODAL = ("can", "could", "should", "would", "may", "might")
DENIALS = ("no", "not", "never", "without", "ineffective", "inefficacy", "doesnt", "doesn't")
MENTIONED = r"\b(?:believ(?:e|ed|es|ing)|participants?|survey|hesitan(?:cy|t)|odds?\s+ratio|misinformation|conspiracy|myth)\b"


def lexically_covers(subclaim: Column, statement: Column) -> Column:
    """A statement that is no mere mention has a word of each half of the part's words, one of its object, and a denial if the part has one.

    Halves go by the words' first places.
    """
    every = lambda x: words.token_set(words.low(x), words.APOSTROPHE, (*words.STOP, *MODAL))
    denies = lambda t: F.exists(t, lambda w: w.isin(*DENIALS))

    def judged(s: Column) -> Column:
        focus = F.filter(s["own"], lambda w: ~w.isin(*DENIALS))
        middle = F.greatest(F.lit(1), F.floor(F.size(focus) / 2).cast("int"))
        left, right = F.slice(focus, 1, middle), F.when(F.size(focus) > middle, F.slice(focus, middle + 1, F.size(focus))).otherwise(focus)
        meets = F.arrays_overlap(left, s["row"]) & F.arrays_overlap(right, s["row"]) & ((F.size(s["object"]) == 0) | F.arrays_overlap(s["object"], s["row"]))
        return (F.size(focus) > 0) & meets & (~denies(s["own"]) | denies(s["row"]))

    return ~words.has(statement, MENTIONED) & words.once(F.struct(every(subclaim).alias("own"), every(statement).alias("row"), words.object_tokens(subclaim).alias("object")), judged)
