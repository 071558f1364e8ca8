"""Hybrid rank: vector and graph candidates of a claim merged, scored on many signals, filtered and ordered.

Claims: claim_id, claim (text), entities. Candidates: claim_id, side ('sem' or
'kg'), seq (their order inside a side), statement, score, entities, source_url,
published_at, credibility, candidate_type, is_backfill. What depends on the
claim alone is worked out once for each distinct claim; what depends on claim
and statement once for each pair of distinct ones where these are few, else row
by row. Everything is keyed by claim_id, so after the merge no row moves again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import domains, scoring, words
from plumbline.functions.once import apart
from plumbline.operators.evidence import minmax
from plumbline.session import by_value, few_pairs, with_values

#: Weights of the seven signals by claim type.
SIGNALS = ("sem", "kg", "entity", "overlap", "recency", "credibility", "quality")
WEIGHTS = {
    "therapeutic": (0.35, 0.08, 0.20, 0.18, 0.08, 0.08, 0.03),
    "causal": (0.28, 0.16, 0.19, 0.18, 0.06, 0.09, 0.04),
    "mechanistic": (0.27, 0.20, 0.19, 0.16, 0.05, 0.09, 0.04),
    "general": (0.31, 0.12, 0.20, 0.15, 0.05, 0.17, 0.03),
}


def merged(candidates: DataFrame) -> DataFrame:
    """One row per claim, statement and source: the better score of each side, and all entities.

    Dates, credibility and type are those of the row that came first, vector
    rows before graph rows; any graph row makes the type KG.
    """
    c = F.col
    kg = c("side") == "kg"
    # dealt by claim once: the rows alike, the scaling and the joins by claim need no further shuffle
    rows = candidates.select("claim_id", "statement", "source_url", "side", "seq", "score", "published_at", "credibility", "candidate_type", "is_backfill", "entities").repartition("claim_id")
    rows = rows.withColumns({"statement": F.trim(F.coalesce("statement", F.lit(""))), "_at": F.struct(kg.alias("k"), c("seq").alias("s")), "_score": F.coalesce("score", F.lit(0.0)), "_domain": F.when(c("credibility").isNull(), domains.bare_domain(c("source_url")))})
    given = F.coalesce(c("credibility"), F.when(domains.is_rooted(c("_domain")), 0.95).otherwise(0.5))
    kind = F.coalesce(F.when(c("candidate_type") != "", c("candidate_type")), F.when(kg, "KG").otherwise("VDB"))
    first = F.min_by(F.struct(c("published_at").alias("published_at"), given.alias("credibility"), kind.alias("kind")), "_at")
    agg = rows.groupBy("claim_id", "statement", "source_url").agg(
        F.min("_at").alias("_at"), first.alias("_first"), F.max(kg).alias("_kg"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(~kg, c("_score"))), F.lit(0.0))).alias("sem_raw"),
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(kg, c("_score"))), F.lit(0.0))).alias("kg_raw"),
        F.max(F.coalesce("is_backfill", F.lit(False))).alias("is_backfill"), F.collect_set("entities").alias("_ents"),
    )
    return agg.select(
        "claim_id", "statement", "source_url", c("_first.published_at").alias("published_at"), c("_first.credibility").alias("credibility"),
        F.when(c("_kg"), "KG").otherwise(c("_first.kind")).alias("candidate_type"), "sem_raw", "kg_raw", "is_backfill",
        F.array_sort(F.array_distinct(F.flatten("_ents"))).alias("entities"), "_at",
    )


#: Lists of text_signals() and asked_signals(), which the scores are made of and which nothing needs after them.
LISTS = ("objects", "focus", "subject", "target", "actions", "own_words", "asked", "asked_names", "asked_words", "anchors", "tokens", "done", "entities")


def asked_signals(claims: DataFrame) -> DataFrame:
    """What the rank needs to know of texts and entities of claims (claim, entities), whose other columns stay."""
    q = F.col("claim")
    before, after = words.direction_tokens(q)
    kind = words.claim_type(q)
    weight = lambda i: F.create_map(*[F.lit(x) for k, w in WEIGHTS.items() for x in (k, w[i])])[F.col("claim_type")]
    return claims.select(
        "*", kind.alias("claim_type"), (F.trim(words.low(q)) != "").alias("context"),
        words.object_tokens(q).alias("objects"), words.token_set(q, words.APOSTROPHE, words.FOCUS_STOP, 3).alias("focus"), before.alias("subject"), after.alias("target"),
        words.actions(q).alias("actions"), words.has(q, words.NEGATED_RANK).alias("negated"), words.has(q, words.BELIEF_CLAIM).alias("belief"),
        words.anchor_terms(q).alias("anchors"), words.has(q, words.ASSERTIVE).alias("assertive"), words.token_set(q, words.RUN, words.OVERLAP_STOP).alias("own_words"),
        words.clean_entities(F.col("entities")).alias("asked_names"), words.entity_words(F.col("entities")).alias("asked_words"), words.about_symptoms(q).alias("symptoms"),
    ).withColumns({f"w_{s}": weight(i) for i, s in enumerate(SIGNALS)} | {"marks": words.anchor_marks(F.col("anchors"))})


def claim_signals(claims: DataFrame) -> DataFrame:
    """What the rank needs to know of each claim, worked out once for claims that are alike."""
    return by_value(claims.select("claim_id", "claim", "entities"), ["claim", "entities"], asked_signals).withColumnRenamed("entities", "asked")


def text_signals(rows: DataFrame) -> DataFrame:
    """Rows of asked_signals() and a statement, with what the rank needs to know of both texts."""
    c, s = F.col, F.col("statement")
    # the forms that anchors are looked for in, once a row
    rows = rows.withColumns({"_low": words.low(s), "_spaced": words.spaced(s)})
    rows = rows.withColumns({
        "furniture": words.contains_any(s, words.LOW_SIGNAL), "anchors_matched": words.marked_hits(c("marks"), c("_low"), c("_spaced")),
        "raw_overlap": words.word_share(c("own_words"), s), "tokens": words.token_set(s, words.APOSTROPHE, (), 2), "done": words.actions(s), "denied": words.has(s, words.NEGATED_RANK),
        "refutes": words.has(s, words.REFUTES_OBJECT), "mentions": words.has(s, words.MENTIONS_CLAIM), "doubt": words.contains_any(s, words.DOUBT),
    })
    required = F.least(F.size("anchors"), F.lit(2))
    rows = rows.drop("_low", "_spaced", "marks").withColumns({
        "anchor_match_score": F.when(F.size("anchors") > 0, c("anchors_matched") / F.size("anchors")).otherwise(0.0), "anchor_ok": c("anchors_matched") >= required,
        "action_ok": (F.size("actions") == 0) | F.arrays_overlap("actions", "done"), "conflict": c("negated") != c("denied"),
        "object_overlap": words.shared(c("objects"), c("tokens")), "focus_overlap": words.shared(c("focus"), c("tokens")),
        "subject_overlap": words.shared(c("subject"), c("tokens")), "target_overlap": words.shared(c("target"), c("tokens")),
    })
    return rows.withColumns({
        "claim_overlap": F.when(c("context") & ~c("anchor_ok"), F.least(c("raw_overlap"), F.lit(0.20))).otherwise(c("raw_overlap")),
        "negation_anchor": words.negation_anchor(c("symptoms"), s, c("anchor_match_score")),
    } | {f"asks_{x}": F.size(x) > 0 for x in ("actions", "objects", "focus", "subject", "target")})


def with_texts(rows: DataFrame, claims: DataFrame, statements: DataFrame) -> DataFrame:
    """Rows (claim_id, statement) with the claim's signals and text_signals(); ``statements`` holds all statements of the rows."""
    few = few_pairs(claims.select("claim", "entities"), statements)
    if few is not None:
        own = rows.join(claims.select("claim_id", "claim", "entities").withColumnRenamed("entities", "asked"), "claim_id")
        out = with_values(own, ["claim", "asked", "statement"], text_signals(asked_signals(few[0]).crossJoin(few[1])).withColumnRenamed("entities", "asked"))
        if out is not None:
            return out
    return text_signals(rows.join(claim_signals(claims), "claim_id"))


def penalty_share(penalties: list[tuple[Column, Column | float]], sem: Column) -> tuple[dict[str, Column], dict[str, Column], Column]:
    """The worst penalty and a quarter of the others, 0.55 at most, less where vectors agree strongly; after two steps of columns that it names, so that each is worked out once."""
    each = {f"_p{i}": F.when(cond, F.lit(value) if isinstance(value, float) else value).otherwise(0.0) for i, (cond, value) in enumerate(penalties)}
    worst = F.greatest(*[F.col(p) for p in each])
    total = reduce(lambda a, b: a + b, [F.col(p) for p in each])
    joint = F.least(F.col("_worst") + 0.25 * (F.col("_all") - F.col("_worst")), F.lit(0.55))
    return each, {"_worst": worst, "_all": total}, F.when(sem >= 0.70, joint * F.greatest(F.lit(0.40), 1 - 0.50 * sem)).otherwise(joint)


def scored(candidates: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """Merged candidates of the claims with all signals, support and contradiction, and final_score."""
    c = F.col
    rows = minmax(minmax(merged(candidates), "sem_raw", "sem"), "kg_raw", "kg").withColumnRenamed("entities", "_named")
    rows = with_texts(rows, claims, candidates.select(F.trim(F.coalesce("statement", F.lit(""))).alias("statement"))).withColumnRenamed("_named", "entities")
    # furniture goes after the scaling, which it takes part in
    rows = rows.filter(~c("furniture")).drop("furniture").withColumns({"_i": words.clean_entities(c("entities")), "_t": words.entity_words(c("entities"))})
    rows = apart(rows, {
        "entity_overlap": words.share_of_entities(c("asked_names"), c("asked_words"), c("_i"), c("_t")), "recency": scoring.recency_decay(c("published_at"), now),
        "quality": words.source_quality(c("source_url"), F.lit(None).cast("string"), c("statement")),
    }, "sem").drop("_i", "_t")
    sem, kg, raw, ent, over, cred = c("sem"), c("kg"), c("kg_raw"), c("entity_overlap"), c("claim_overlap"), c("credibility")
    known = F.lit(0)
    for x in (sem, kg, ent, over):
        known = known + (x >= 0.30).cast("int")
    is_kg = c("candidate_type") == "KG"
    base = c("w_sem") * sem + c("w_kg") * kg + c("w_entity") * ent + c("w_overlap") * over + c("w_recency") * c("recency") + c("w_credibility") * cred + c("w_quality") * c("quality")
    base = base + 0.05 * F.greatest(F.lit(0), known - 1) + F.when(cred >= 0.90, 0.30).when(cred >= 0.75, 0.10).otherwise(0.0) + 0.07 * c("negation_anchor")
    base = base + F.when((raw > 0) & ((over >= 0.08) | ~c("context")), 0.05 * F.least(F.lit(1.0), raw)).otherwise(0.0)
    base = base + F.when((kg > 0) & (ent >= 0.34) & ((over >= 0.10) | ~c("context")), 0.10).otherwise(0.0)
    base = base + F.when(is_kg & (raw >= 0.40) & c("anchor_ok"), 0.08).otherwise(0.0)
    unless = lambda x: (sem < x) & (raw < x)
    none = lambda x: c(f"asks_{x}") & (c(f"{x}_overlap") == 0)
    each, parts, share = penalty_share(
        [
            (c("anchor_match_score") < 0.20, F.when(is_kg, 0.50).otherwise(0.25)),
            (c("is_backfill") & ~((ent >= 0.25) | (kg >= 0.55) | (raw >= 0.55)), 0.12),
            (c("asks_actions") & ~c("action_ok") & unless(0.95), 0.20),
            (c("asks_objects") & (c("object_overlap") == 0) & ~c("refutes"), 0.30),
            (c("asks_focus") & (c("focus_overlap") <= 1) & unless(0.85), 0.18),
            (none("subject") & unless(0.90), 0.25),
            (none("target") & unless(0.90), 0.20),
            (none("subject") & none("target"), 0.40),
            (~c("belief") & c("mentions"), 0.25),
        ],
        sem,
    )
    rows = apart(apart(rows, {"base": base} | each, "sem").withColumns(parts), {"share": share}, "sem").drop(*each, *parts)
    base, share = c("base"), c("share")
    opposed = c("conflict") & (over >= 0.45)
    hint = F.when(c("target_overlap") > 0, 1.0).when(c("object_overlap") > 0, 0.35).otherwise(0.0)
    mismatch = F.least(F.lit(0.28), 0.10 + 0.22 * (1 - scoring.clamp01(0.55 * hint + 0.45 * c("anchor_match_score"))))
    echo = is_kg & (over >= 0.92) & (c("anchor_match_score") >= 0.85) & (sem < 0.15) & (raw >= 0.70)
    total = base * F.when(c("context"), 1 - share).otherwise(1.0) * F.when(c("context") & opposed, 1 - mismatch).otherwise(1.0) * F.when(echo, 0.82).otherwise(1.0)
    total = total - F.when(c("context") & c("assertive") & c("doubt"), 0.12).otherwise(0.0)
    total = F.when((sem == 0) & (kg == 0) & (cred >= 0.90), F.greatest(total, F.lit(0.2))).otherwise(total)
    acts = c("asks_actions")
    did = c("action_ok").cast("double")
    predicate = F.when(acts, F.when(over >= 0.20, F.greatest(did, F.least(F.lit(1.0), over))).otherwise(did)).otherwise(F.least(F.lit(1.0), F.greatest(over, c("anchor_match_score"))))
    path = F.greatest(kg, F.least(F.lit(1.0), raw))
    aligned = F.when(c("target_overlap") > 0, 1.0).when(c("object_overlap") > 0, 0.4).otherwise(0.0)
    scope = scoring.clamp01(0.55 * over + 0.45 * c("anchor_match_score"))
    rows = apart(rows, {"total": total, "predicate_match": predicate}, "sem").drop("base", "share")
    support = scoring.clamp01(0.30 * c("predicate_match") + 0.20 * aligned + 0.15 * c("quality") + 0.15 * scope + 0.20 * path) * F.when(c("context") & opposed, 0.72).otherwise(1.0)
    differs = F.greatest(F.when(acts & ~c("action_ok"), 1.0).otherwise(0.0), F.when(opposed, 0.75).otherwise(0.0))
    explicit = c("refutes").cast("double")
    by_path = F.when((explicit > 0) | (differs > 0), path).otherwise(0.0)
    against = scoring.clamp01(0.38 * F.greatest(c("negation_anchor"), explicit) + 0.22 * differs + 0.18 * F.greatest(F.lit(0.0), 1 - c("predicate_match")) + 0.22 * by_path)
    rows = apart(rows, {"support_score": support, "contradict_score": against}, "sem")
    final = scoring.clamp01(0.92 * scoring.clamp01(c("total")) + 0.08 * F.greatest("support_score", "contradict_score"))
    # what meets a threshold or an order is rounded, so that the order of additions does not show
    return apart(rows, {"final_score": F.round(final, 9)}, "sem").withColumns({x: F.round(x, 9) for x in ("support_score", "contradict_score", "claim_overlap", "entity_overlap", "recency", "credibility")})


def admitted() -> Column:
    """Whether a scored candidate stays, by the rules for claims with words and for those without."""
    c = F.col
    sem, raw, over, ent = c("sem"), c("kg_raw"), c("claim_overlap"), c("entity_overlap")
    unless = lambda x: (sem < x) & (raw < x)
    acts = c("asks_actions") & ~c("action_ok")
    off_target = c("asks_target") & (c("target_overlap") == 0)
    drop = (over < 0.15) & (sem < 0.75) & ~(((c("kg") >= 0.55) | (raw >= 0.45)) & (ent >= 0.20) & (over >= 0.08))
    drop = drop | (c("asks_objects") & (c("subject_overlap") == 0) & (c("target_overlap") == 0) & (over < 0.40) & unless(0.90) & ~c("refutes"))
    drop = drop | (c("asks_focus") & (c("focus_overlap") <= 1) & (over < 0.35) & unless(0.90))
    drop = drop | (c("asks_subject") & (c("subject_overlap") == 0) & unless(0.95))
    drop = drop | (off_target & unless(0.95))
    drop = drop | (~c("belief") & c("mentions") & (over < 0.60))
    drop = drop | (acts & off_target & (over < 0.75) & (raw < 0.95))
    drop = drop | (acts & (over < 0.45) & unless(0.92))
    drop = drop | ((sem < 0.20) & (over < 0.08) & (ent < 0.20) & (raw < 0.40))
    noise = (sem == 0) & (raw == 0) & (ent == 0) & (c("credibility") < 0.15) & (c("final_score") < 0.05)
    return F.when(c("context"), ~drop).otherwise(~noise)


def hybrid_rank(candidates: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """scored() rows that are admitted, with ``rank`` inside their claim.

    Where a claim had graph candidates and none is admitted, the best of those
    dropped comes back if its score is enough.
    """
    c = F.col
    claim = Window.partitionBy("claim_id")
    graph = (c("candidate_type") == "KG") | (c("kg_raw") > 0)
    # a graph candidate among the rows to be ranked; the input held one where any row of the claim is of that kind
    rows = apart(scored(candidates, claims, now), {"_in": admitted(), "_graph": graph, "_kg": (c("kg") > 0) | (c("candidate_type") == "KG")}, "sem")
    rows = rows.withColumns({"_lost": F.max(c("_in") & c("_kg")).over(claim)})
    best = F.row_number().over(claim.orderBy((c("_graph") & ~c("_in")).desc(), c("final_score").desc(), "_at"))
    back = ~c("_lost") & c("_graph") & ~c("_in") & (c("_best") == 1) & ((c("kg_raw") >= 0.20) | (c("final_score") >= 0.08))
    rows = rows.withColumn("_best", best).filter(c("_in") | back)
    order = [c("final_score").desc(), c("credibility").desc(), c("support_score").desc(), c("recency").desc(), c("statement"), c("source_url").asc_nulls_first()]
    return rows.withColumn("rank", F.row_number().over(claim.orderBy(*order))).drop("_in", "_graph", "_kg", "_lost", "_best", "_at")


#: Rows that a pair model reads for a claim, five at least, and its share of their score.
RERANKED, LEAST_RERANKED, PAIR_SHARE = 30, 5, 0.25


def reranked(ranked: DataFrame, claims: DataFrame, score: Callable[[list[tuple[str, str]]], Sequence[float]], most: int = RERANKED) -> DataFrame:
    """Ranked rows (claim_id, rank, statement, final_score, ..) with a pair model's view of a claim's first ones, ranked anew.

    ``score`` gets (claim, statement) pairs in batches; what it gives outside 0..1
    is taken for a logit. The first rows are sorted by their blended score, then
    the model's, then the statement, the others follow as they were. Claims
    without text, and null final scores as 0, are left as they are. The model sees
    only the first rows; the ranks need no shuffle but the one by claim.
    """
    c, first = F.col, F.col("rank") <= max(LEAST_RERANKED, most)

    @F.pandas_udf("double")
    def judged(claim: pd.Series, statement: pd.Series) -> pd.Series:
        return pd.Series(list(score(list(zip(claim, statement, strict=True)))), dtype="float64")

    rows = ranked.join(claims.select("claim_id", "claim"), "claim_id")
    asked = first & (F.coalesce("claim", F.lit("")) != "")
    head = rows.filter(asked).withColumn("raw", judged(c("claim"), F.coalesce("statement", F.lit(""))))
    inside = F.when(c("raw").between(0.0, 1.0), c("raw")).otherwise(scoring.sigmoid(c("raw")))
    blended = (1 - PAIR_SHARE) * F.coalesce("final_score", F.lit(0.0)) + PAIR_SHARE * inside
    both = head.withColumns({"pair_score": inside, "final_score": blended}).drop("raw").unionByName(rows.filter(~asked).withColumn("pair_score", F.lit(None).cast("double")))
    order = [c("pair_score").isNull(), F.when(c("pair_score").isNull(), c("rank")), F.round("final_score", 9).desc(), F.round("pair_score", 9).desc(), F.coalesce("statement", F.lit("")), c("rank")]
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy(*order))).drop("claim")
