"""Filters and folds over a claim's evidence: gates, grades, stance scores, overrides and fingerprints.

Everything is keyed by claim_id; rows are never paired with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import policy, scoring, text, words
from plumbline.functions.once import apart, once
from plumbline.functions.scoring import clamp01
from plumbline.operators.verdict import heuristic_nli

GRADES = ("A+", "A", "B", "C", "D", "F")


def by_score(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rows that reach the threshold; no score counts as 0."""
    return df.filter(F.coalesce(F.col(score), F.lit(0.0)) >= threshold)


def by_grade(df: DataFrame, least: str = "C", grade: str = "grade") -> DataFrame:
    """Rows graded ``least`` or better; an unknown ``least`` counts as C, a row without a grade as F."""
    listed = F.array(*[F.lit(g) for g in GRADES[: GRADES.index(least if least in GRADES else "C") + 1]])
    return df.filter(F.array_contains(listed, F.coalesce(F.col(grade), F.lit("F"))))


def graded(df: DataFrame) -> DataFrame:
    """df (final_score, sem_score, credibility, entity_overlap, recency) with grade, semantic_confidence and the reasons in words."""
    c = F.col
    final, sem, cred = (F.coalesce(x, F.lit(d)) for x, d in (("final_score", 0.0), ("sem_score", 0.0), ("credibility", 0.5)))
    ent, rec = F.coalesce("entity_overlap", F.lit(0.0)), F.coalesce("recency", F.lit(0.0))
    blend = F.round(clamp01(F.greatest(final, 0.55 * final + 0.25 * sem + 0.20 * cred)), 9)
    said = lambda words_, x: F.concat(F.lit(words_), F.format_string("%.2f", x), F.lit(")"))
    reasons = F.concat_ws(
        "; ",
        F.when(sem >= 0.6, said("high semantic match (", sem)).when(sem >= 0.4, said("fair semantic match (", sem)),
        F.when(cred >= 0.75, said("trusted source (", cred)).when(cred >= 0.5, said("moderate credibility (", cred)),
        F.when(ent >= 0.7, said("strong entity overlap (", ent)).when(ent >= 0.3, said("some entity match (", ent)),
        F.when(rec >= 0.5, said("recent source (", rec)),
    )
    rows = apart(df, {"grade": once(blend, scoring.grade), "semantic_confidence": scoring.semantic_label(clamp01(sem)), "grade_rationale": reasons}, "final_score")
    return rows.withColumn("grade_rationale", F.when(c("grade_rationale") == "", "low confidence across all signals").otherwise(c("grade_rationale")))


def count_gate(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates (claim_id, side, statement, fact_type) that a claim lets through.

    A claim about a count takes only statements with numbers that name one of its
    entities, or, from vectors, that are counts themselves; others take all.
    """
    asked = claims.select("claim_id", policy.is_count_claim(F.col("claim")).alias("_counts"), words.token_set(F.array_join(F.coalesce("entities", F.array().cast("array<string>")), " \n "), words.ALPHA).alias("_names"))
    named = F.arrays_overlap(words.token_set(F.col("statement"), words.ALPHA), "_names")
    counted = (F.col("side") == "sem") & (F.coalesce("fact_type", F.lit("")) == "count")
    rows = candidates.join(asked, "claim_id")
    return rows.filter(~F.col("_counts") | (words.has(F.col("statement"), policy.COUNT_NUMBER) & (named | counted))).drop("_counts", "_names")


def rationale(df: DataFrame, polarity: str, least: float = 0.40) -> DataFrame:
    """Evidence (semantic_score, stance, statement) on whether something works, of one polarity; an unknown polarity takes both."""
    sides = {"CONTRADICTS": ("CONTRADICTS", "CONTRA", "REFUTES"), "SUPPORTS": ("SUPPORTS", "PRO", "ENTAILS")}
    keep = (F.coalesce("semantic_score", F.lit(0.0)) >= least) & policy.efficacy_relevant(F.col("statement"))
    if polarity.upper() in sides:
        keep = keep & F.upper(F.coalesce("stance", F.lit(""))).isin(*sides[polarity.upper()])
    return df.filter(keep)


def sided_ids(df: DataFrame, least: float = 0.35) -> DataFrame:
    """Per claim, the ids of evidence with a score of ``least`` on each side, in their order, and how many they are."""
    stance, seen = F.upper(F.coalesce("stance", F.lit(""))), F.coalesce("semantic_score", F.lit(0.0)) >= least
    ids = lambda names: F.array_sort(F.collect_list(F.when(seen & stance.isin(*names), F.col("evidence_id"))))
    agg = df.groupBy("claim_id").agg(ids(("CONTRADICTS", "CONTRA", "REFUTES")).alias("contradicting"), ids(("SUPPORTS", "PRO", "ENTAILS")).alias("supporting"))
    return agg.withColumns({"n_contradicting": F.size("contradicting"), "n_supporting": F.size("supporting")})


def conflict_texts(statement: Column) -> dict[str, Column]:
    """What without_conflicts() reads in a statement: its signature, and whether it denies."""
    sig = text.statement_signature(statement)
    return {"_sig": F.when(sig == "", F.trim(words.low(statement))).otherwise(sig), "_neg": words.has(statement, words.NEGATED_PHASE)}


def without_conflicts(df: DataFrame) -> DataFrame:
    """Of a claim's rows alike but for negation and from one source, the one that a fold in the order of seq ends with.

    Of equal polarity the next row needs a higher final_score; of opposite ones
    the better informed stays, and the negated one where they are within 0.03.
    Only rows of one claim, source and signature are gathered, a handful. Rows
    may bring conflict_texts() as columns, which do not come back.
    """
    c = F.col
    source = F.trim(F.lower(F.coalesce("source_url", F.lit(""))))
    texts = conflict_texts(c("statement"))
    kept = [x for x in df.columns if x not in texts]
    texts = {} if len(kept) < len(df.columns) else texts
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    info = F.round(0.45 * zero("final_score") + 0.20 * zero("anchor_match_score") + 0.20 * F.abs(zero("support_score") - zero("contradict_score")) + 0.15 * zero("credibility"), 9)
    rows = df.withColumns(texts | {"_src": F.when(source == "", "__no_source__").otherwise(source), "_info": info, "_final": zero("final_score")})
    item = F.struct("seq", "_neg", "_info", "_final", F.struct(*[F.col(x) for x in kept]).alias("row"))

    def step(a: Column, b: Column) -> Column:
        same = b["_final"] > a["_final"]
        gap = F.round(b["_info"] - a["_info"], 9)
        other = F.when(F.abs(gap) <= 0.03, b["_neg"] & ~a["_neg"]).otherwise(gap > 0)
        return F.when(F.when(a["_neg"] == b["_neg"], same).otherwise(other), b).otherwise(a)

    listed = rows.groupBy("claim_id", "_src", "_sig").agg(F.array_sort(F.collect_list(item), lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)).alias("items"))
    left = F.reduce(F.slice("items", 2, F.greatest(F.size("items"), F.lit(1))), F.get("items", F.lit(0)), step)
    # the claim is that of the group, so what follows finds its rows dealt by claim
    return listed.select("claim_id", left.alias("x")).select(*[F.col(x) if x == "claim_id" else F.col("x.row").getField(x).alias(x) for x in kept])


def fingerprint(df: DataFrame, salt: str = "") -> DataFrame:
    """Per claim, the SHA-256 over its evidence (evidence_id, domain, source_url, statement) in the order of rank."""
    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    line = F.concat(blank("evidence_id"), blank("domain"), blank("source_url"), F.substring(blank("statement"), 1, 400), F.lit("\n"))
    listed = df.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    return listed.select("claim_id", F.sha2(F.concat(F.lit(salt), F.array_join("rows.line", "")), 256).alias("snapshot_id"))


#: Words left out where a statement is read against a claim.
READ_STOP = (*words.STOP, "can", "could", "should", "would", "may", "might")
#: What a relevance label says before any reading: for, against, neither.
PRIORS = {"SUPPORTS": (0.72, 0.08, 0.20), "REFUTES": (0.08, 0.72, 0.20), "NEUTRAL": (0.25, 0.25, 0.50)}


def with_evidence(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows of an evidence map, blank statements and sources filled from the evidence of the same id; rows without a valid id go."""
    known = evidence.select("claim_id", "evidence_id", F.col("statement").alias("_s"), F.col("source_url").alias("_u"))
    filled = lambda own, other: F.coalesce(F.when(F.col(own) != "", F.col(own)), F.col(other), F.lit(""))
    return rows.filter("evidence_id >= 0").join(known, ["claim_id", "evidence_id"], "left").withColumns({"statement": filled("statement", "_s"), "source_url": filled("source_url", "_u")}).drop("_s", "_u")


def evidence_scores(rows: DataFrame, claims: DataFrame, top_n: int = 5) -> DataFrame:
    """Rows of an evidence map with their shares for, against and neither, whether they count, and their weight.

    rows: claim_id, evidence_id, statement, source_url, relevance,
    relevance_score, contradiction_score, predicate_match_score,
    negation_anchor_overlap, credibility, scope_alignment, blocked, nli_entail,
    nli_contradict, nli_neutral. Of rows that may refute, the ``top_n`` of a claim
    by their first score (ties: the smaller id) are read against the claim.
    Rows without an id, or with a negative one, are left out.
    """
    c = F.col
    zero = lambda x: clamp01(F.coalesce(F.col(x), F.lit(0.0)))
    unless = lambda x, d: clamp01(F.when(F.coalesce(F.col(x), F.lit(0.0)) == 0, d).otherwise(F.col(x)))
    asked = claims.select("claim_id", (F.coalesce("claim", F.lit("")) == "").alias("_mute"), words.token_set(c("claim"), words.ALPHA, READ_STOP).alias("_own"), words.has(c("claim"), words.NEGATED_STANCE).alias("_denies"), words.has(c("claim"), words.NEGATED_NLI).alias("_negates"))
    d = rows.filter("evidence_id >= 0").join(asked, "claim_id").withColumn("label", policy.relevance_label(c("relevance")))
    differs = c("_denies") != words.has(c("statement"), words.NEGATED_STANCE)
    first = clamp01(0.35 * zero("negation_anchor_overlap") + 0.35 * zero("contradiction_score") + 0.20 * differs.cast("double") + 0.10 * (1 - zero("predicate_match_score")))
    d = d.withColumn("stage1", F.round(first, 9))
    turn = F.row_number().over(Window.partitionBy("claim_id").orderBy((c("stage1") >= 0.30).desc(), c("stage1").desc(), "evidence_id"))
    # written once, as what is read names them many times
    d = d.withColumns({"_turn": turn, "_other": words.token_set(c("statement"), words.ALPHA, READ_STOP), "_opposed": c("_negates") != words.has(c("statement"), words.NEGATED_NLI)})
    turn, own, other, opposed = c("_turn"), c("_own"), c("_other"), c("_opposed")
    over = words.shared(own, other) / F.greatest(F.lit(1), F.size(own))
    silent, wordless = c("_mute") | (F.coalesce("statement", F.lit("")) == ""), (F.size(own) == 0) | (F.size(other) == 0)
    read = [
        F.when(silent, s).when(wordless, w).otherwise(x)
        for x, s, w in zip(heuristic_nli(over, opposed), (0.0, 0.0, 1.0), (0.25, 0.25, 0.50), strict=True)
    ]
    prior = [F.coalesce(*[F.when(c("label") == k, v[i]) for k, v in PRIORS.items()]) for i in range(3)]
    blank = (zero("nli_entail") == 0) & (zero("nli_contradict") == 0) & (zero("nli_neutral") == 0)
    given = [F.when(blank, p).otherwise(zero(x)) for p, x in zip(prior, ("nli_entail", "nli_contradict", "nli_neutral"), strict=True)]
    d = d.withColumn("verified", (turn <= top_n) & (c("stage1") >= 0.30)).withColumns({f"n{i}": F.when(c("verified"), F.when(r == 0, g).otherwise(r)).otherwise(g) for i, (r, g) in enumerate(zip(read, given, strict=True))})
    e, r, n = c("n0"), c("n1"), c("n2")
    against = F.when((c("label") == "SUPPORTS") & (e >= r), F.least(r, F.lit(0.22))).otherwise(r)
    entail = F.when((c("label") == "REFUTES") & (r >= e), F.least(e, F.lit(0.22))).otherwise(e)
    parts = [clamp01(0.40 * p + 0.60 * x) for p, x in zip(prior, (entail, against, n), strict=True)]
    total = F.greatest(F.lit(1e-9), parts[0] + parts[1] + parts[2])
    counts = ~F.coalesce("blocked", F.lit(False)) & (zero("relevance_score") >= 0.05)
    weight = zero("relevance_score") * unless("credibility", 0.5) * unless("scope_alignment", 1.0)
    return d.select(
        "claim_id", "evidence_id", "source_url", c("label").alias("relevance"), "stage1", "verified", (c("verified") & (r >= 0.45)).alias("refute_verified"),
        *[(p / total).alias(x) for p, x in zip(parts, ("p_support", "p_against", "p_neutral"), strict=True)], counts.alias("admissible"), F.when(counts, weight).otherwise(0.0).alias("weight"),
    )


def overrides(claims: DataFrame, strengths: DataFrame, segments: DataFrame) -> DataFrame:
    """The outcome of the claim logic, one row per claim.

    claims: claim_id, claim, verdict, truthfulness, confidence, diversity,
    agreement, evidence_count, kg_hint. strengths: claim_id, strength (of
    policy.strength). segments: claim_id, status. The first rule that fires
    decides; a confidence above its cap is an outcome of its own.
    """
    c = F.col
    s = lambda x: F.col(f"strength.{x}")
    side = lambda stance, x: F.when(s("stance") == stance, s(x))
    told = strengths.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s("stance") == "REFUTES").alias("n_refutes"), *[F.coalesce(F.sum(side(k, "support")), F.lit(0.0)).alias(f"sum_{k}") for k in ("SUPPORTS", "REFUTES")],
        F.coalesce(F.avg(side("SUPPORTS", "hedge")), F.lit(0.0)).alias("hedge"), F.coalesce(F.avg(side("SUPPORTS", "rarity")), F.lit(0.0)).alias("rarity"), F.coalesce(F.avg(side("REFUTES", "support")), F.lit(0.0)).alias("refuting"),
    )
    st = F.upper(F.coalesce("status", F.lit("UNKNOWN")))
    covered = lambda whole, half: F.avg(F.when(st.isin(*whole), 1.0).when(st.isin(*half), 0.5).otherwise(0.0))
    split = segments.groupBy("claim_id").agg(covered(("VALID", "STRONGLY_VALID"), ("PARTIALLY_VALID",)).alias("valid"), covered(("INVALID",), ("PARTIALLY_INVALID",)).alias("invalid"), covered(("UNKNOWN",), ()).alias("open"))
    d = claims.join(told, "claim_id", "left").join(split, "claim_id", "left").fillna(0).withColumn("strict", policy.strictness(c("claim")))
    n = F.greatest(c("n"), F.lit(1))
    d = d.withColumns({
        "support_coverage": F.round(F.greatest("valid", clamp01(c("sum_SUPPORTS") / n)), 9), "refute_coverage": F.round(F.greatest("invalid", clamp01(c("sum_REFUTES") / n)), 9), "high": c("strict.level").isin("HIGH", "VERY_HIGH"),
        "refute_diversity": F.round(F.when(c("n_refutes") > 0, clamp01(F.least(F.lit(1.0), c("n_refutes") / F.greatest(F.lit(1), c("evidence_count"))) * F.greatest(F.lit(0.0), c("diversity")))).otherwise(0.0), 9),
        "said": F.upper(F.coalesce("verdict", F.lit("UNVERIFIABLE"))),
    })
    sup, ref = c("support_coverage"), c("refute_coverage")
    force = c("high") & (ref >= 0.50) & (c("refute_diversity") >= 0.35)
    hedged = c("high") & (c("said") == "TRUE") & ((c("hedge") >= 0.45) | (c("rarity") >= 0.40)) & ((ref >= 0.25) | (c("refuting") >= 0.45))
    chained = (c("strict.is_conditional") | c("strict.is_multi_step")) & (c("said") == "UNVERIFIABLE") & (sup >= 0.45) & (ref < 0.30)
    relaxed = chained & (F.least(F.lit(1.0), sup + F.least(F.greatest(c("kg_hint"), F.lit(0.0)), F.lit(0.15))) >= 0.55)
    cap = F.least(
        F.when(c("diversity") < 0.10, 0.70).when(c("diversity") < 0.20, 0.80).otherwise(0.98), F.when(c("evidence_count") < 3, 0.75).otherwise(0.98), F.when(c("agreement") < 0.70, 0.75).otherwise(0.98),
        F.when(c("high") & (c("diversity") < 0.20), 0.72).otherwise(0.98),
    )
    capped = F.greatest(F.lit(0.05), F.least(cap, F.greatest(F.lit(0.0), c("confidence"))))
    d = d.withColumns({"force": force, "hedged": hedged & ~force, "relaxed": relaxed & ~force & ~hedged, "capped": capped}).withColumn("cap_fired", c("capped") + 1e-9 < c("confidence"))
    false = c("force") | (c("hedged") & (ref >= 0.45))
    truth = F.when(c("force"), F.least(c("truthfulness"), F.lit(20.0))).when(c("hedged"), F.when(ref >= 0.45, 20.0).otherwise(55.0)).when(c("relaxed"), F.greatest(c("truthfulness"), F.lit(45.0)))
    return d.select(
        "claim_id", F.when(c("force"), "CONTRADICTION_DOMINANCE").when(c("hedged"), "HEDGE_MISMATCH").when(c("relaxed"), "MULTIHOP_RELAXATION").when(c("cap_fired"), "DIVERSITY_CAP").otherwise("NONE").alias("override_fired"),
        F.when(false, "FALSE").when(c("hedged"), "UNVERIFIABLE").when(c("relaxed"), "PARTIALLY_TRUE").otherwise(c("said")).alias("verdict"), F.round(truth, 3).alias("truthfulness_cap"), F.when(c("force"), 0.55).alias("confidence_floor"),
        F.round("capped", 3).alias("confidence_cap"), "support_coverage", "refute_coverage", "refute_diversity", c("open").alias("unresolved_ratio"), c("high").alias("strictness_high"), "cap_fired",
    )


def shadow_diff(old: DataFrame, new: DataFrame, key: str = "claim_id") -> DataFrame:
    """Both payloads of each key side by side: which of their shared fields differ, and by how much the numbers do."""
    shared = [x for x in old.columns if x in new.columns and x != key]
    number = {f.name for f in old.schema.fields if f.dataType.simpleString() in ("int", "bigint", "double", "float")}
    a, b = old.select(key, *[F.col(x).alias(f"_a_{x}") for x in shared]), new.select(key, *[F.col(x).alias(f"_b_{x}") for x in shared])
    both = a.join(b, key, "full")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"_a_{x}").eqNullSafe(F.col(f"_b_{x}")), F.lit(x)) for x in shared]))
    return both.select(key, differs.alias("changed"), *[(F.col(f"_b_{x}") - F.col(f"_a_{x}")).alias(f"delta_{x}") for x in shared if x in number])
