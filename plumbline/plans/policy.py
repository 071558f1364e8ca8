"""Queries on claim policy: gates, strictness, strength, overrides, stance scores and bands; worded.py says what stands for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import policy, scoring, words
from plumbline.functions.once import apart
from plumbline.operators import logic
from plumbline.plans import worded
from plumbline.plans.claims import _c01, _sig
from plumbline.plans.ranking import CLAIM_SIGNALS, MERGED, RANKED, _ranked
from plumbline.plans.registry import _r, query
from plumbline.plans.worded import CLAIMS_SQL, EVIDENCE_SQL, s_any, s_has, s_hits, s_low, s_set, s_shared, s_tokens, sql_text
from plumbline.session import by_value

DECLARED = ("health", "general", "sports", None, "Medicine ")


def _sum(parts: list[str]) -> str:
    return " + ".join(parts)


# single claims

HITS = {k: s_hits("claim", v) for k, v in (("u", policy.UNIVERSAL), ("b", policy.BROAD), ("t", policy.TENTATIVE), ("d", policy.DEFINITIVE), ("ca", policy.CAUSAL), ("co", policy.COMPARATIVE), ("cn", policy.CONDITIONAL), ("sy", words.SYMPTOM_PHRASES))}
STRICT = f"""
h AS (SELECT claim_id, claim, {', '.join(f'{v} AS {k}' for k, v in HITS.items())}, len(regexp_extract_all({s_low('claim')}, {sql_text(policy.NUMBER)})) AS nums, len(regexp_extract_all({s_low('claim')}, {sql_text(policy.UNIT)})) AS units FROM (SELECT * REPLACE (trim(coalesce(claim, '')) AS claim) FROM c)),
i AS (SELECT *, {_c01('(1.3 * u + 0.9 * d + 0.7 * ca + 0.4 * b) / 4.0')}::DOUBLE AS assertive, {_c01('(1.2 * u + 0.6 * b) / 2.0')}::DOUBLE AS scope, {_c01('(1.0 + 0.8 * d + 0.7 * u - 0.8 * t - 0.6 * cn) / 2.0')}::DOUBLE AS modality,
    least(1, {_c01('(0.9 * (nums + units) + 0.8 * co + 0.6 * ca + 0.4 * u) / 3.0')} + CASE WHEN nums + units > 0 OR co > 0 THEN 0.08 ELSE 0 END)::DOUBLE AS testable,
    CASE WHEN nums > 0 OR contains(claim, '%') THEN 'NUMERIC' WHEN co > 0 THEN 'COMPARATIVE' WHEN ca > 0 AND {s_has('claim', r'\b(risk|odds|likelihood|probability)\b')} THEN 'RISK_ASSOCIATION'
        WHEN ca > 0 AND {s_has('claim', r'\b(cure|prevent|eliminate|treat|reverse)\b')} THEN 'PREVENTION_TREATMENT' WHEN ca > 0 THEN 'CAUSAL' ELSE 'FACTUAL' END AS claim_type,
    cn > 0 OR {s_has('claim', r'\b(if|when|unless|depending)\b')} AS is_conditional, {s_has('claim', r'\b(and|then|therefore|through|via)\b')} AND {s_has('claim', '[,.;:]')} AS is_multi_step FROM h),
strict AS (SELECT *, round(least(1, {_c01('0.4 * assertive + 0.3 * scope + 0.3 * modality')} + CASE WHEN claim_type IN ('CAUSAL', 'PREVENTION_TREATMENT', 'NUMERIC', 'COMPARATIVE') THEN 0.08 ELSE 0 END), 9) AS idx FROM i),
lv AS (SELECT *, CASE WHEN idx >= 0.82 THEN 'VERY_HIGH' WHEN idx >= 0.70 THEN 'HIGH' WHEN idx >= 0.52 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM strict)
"""


@query(f"WITH {CLAIMS_SQL}, {STRICT} SELECT claim_id, round(assertive, 4) AS assertiveness, round(scope, 4) AS universality, round(modality, 4) AS modality, round(testable, 4) AS falsifiability, claim_type, level, is_conditional, is_multi_step, round(least(1, sy / 2.0), 4)::DOUBLE AS symptom_inference FROM lv")
def u47_claim_strictness(spark: SparkSession, d: str) -> DataFrame:
    return worded.claims(spark, d).select("claim_id", policy.strictness(F.col("claim")).alias("s")).select("claim_id", "s.*")


HEALTH_SQL = _sum([f"CASE WHEN {s_has('claim', p)} THEN {w}::DOUBLE ELSE 0 END" for p, w in policy.HEALTH])


@query(f"""
WITH {CLAIMS_SQL}, s AS (SELECT claim_id, claim, lower(trim(coalesce({worded.sql_pick(DECLARED, 'claim_id')}, ''))) AS declared FROM c),
t AS (SELECT *, CASE WHEN trim({s_low('claim')}) = '' THEN 0 ELSE {_c01(HEALTH_SQL + " + CASE WHEN declared IN ('health', 'biomedical', 'medicine') THEN 0.10 WHEN declared NOT IN ('', 'general', 'unknown') THEN -0.05 ELSE 0 END")} END AS sure FROM s)
SELECT claim_id, round(sure, 9) >= 0.45 AS in_scope, round(sure, 4)::DOUBLE AS confidence, CASE WHEN trim({s_low('claim')}) = '' THEN 'empty_claim' WHEN round(sure, 9) >= 0.45 THEN 'health_scope_detected' ELSE 'insufficient_health_scope_signal' END AS reason FROM t
""")
def f49_health_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.claims(spark, d).select("claim_id", policy.health_scope(F.col("claim"), worded.pick(DECLARED, F.col("claim_id"))).alias("s"))
    return rows.select("claim_id", "s.*")


@query(f"""
WITH {CLAIMS_SQL} SELECT claim_id, {s_has('claim', r'\bhow many\b|\bnumber of\b')} OR ({s_has('claim', policy.COUNT_NUMBER)} AND {s_any('claim', policy.COUNTED)}) AS counts,
    CASE WHEN {s_any('claim', ('hoax', 'fake', 'myth'))} THEN 'FALSE' WHEN {s_any('claim', ('significantly', 'guaranteed', 'always', 'never', 'detoxifies'))} THEN 'FALSE' WHEN {s_any('claim', ('improves', 'supports', 'is linked to', 'can reduce'))} THEN 'TRUE' ELSE 'FALSE' END AS verdict,
    CASE WHEN {s_any('claim', ('hoax', 'fake', 'myth'))} THEN 22.0 WHEN {s_any('claim', ('significantly', 'guaranteed', 'always', 'never', 'detoxifies'))} THEN 38.0 WHEN {s_any('claim', ('improves', 'supports', 'is linked to', 'can reduce'))} THEN 63.0 ELSE 40.0 END::DOUBLE AS truthfulness FROM c
""")
def f4_f58_count_claims_and_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.claims(spark, d).select("claim_id", policy.is_count_claim(F.col("claim")).alias("counts"), policy.fallback_verdict(F.col("claim")).alias("f"))
    return rows.select("claim_id", "counts", "f.verdict", "f.truthfulness")


# single statements

LABELS = ("supports", " VALID ", "contradicts", "Partially_Invalid", "neutral", None, "")


@query(f"""
WITH {EVIDENCE_SQL} SELECT claim_id, seq, {s_has('statement', policy.BLOCKED)} AS blocked, {s_has('statement', policy.EFFICACY)} AS efficacy, coalesce(CASE upper(trim({worded.sql_pick(LABELS, 'seq')})) WHEN 'SUPPORTS' THEN 'SUPPORTS' WHEN 'VALID' THEN 'SUPPORTS' WHEN 'CONTRADICTS' THEN 'REFUTES' WHEN 'PARTIALLY_INVALID' THEN 'REFUTES' END, 'NEUTRAL') AS relevance,
    CASE WHEN {s_has('statement', policy.BLOCKED)} THEN 'blocked_content' WHEN coalesce(statement, '') = '' THEN 'empty_statement' WHEN NOT (quantity > 5) THEN 'topic_guard' WHEN stance = 'neutral' THEN 'claim_guard' WHEN coalesce(credibility, 0) < 0.15 THEN 'predicate_guard' ELSE 'ok' END AS reason FROM ev
""")
def f25_f26_f28_u58_admissibility(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = worded.evidence(spark, d)
    reason = policy.inadmissible_reason(policy.blocked(c("statement")), c("statement"), c("quantity") > 5, c("stance") != "neutral", c("credibility"))
    return rows.select("claim_id", "seq", policy.blocked(c("statement")).alias("blocked"), policy.efficacy_relevant(c("statement")).alias("efficacy"), policy.relevance_label(worded.pick(LABELS, c("seq"))).alias("relevance"), reason.alias("reason"))


@query("""
SELECT o_orderkey AS id, CASE WHEN x <= 24 THEN 'LIKELY_FALSE' WHEN x <= 44 THEN 'MOSTLY_FALSE' WHEN x <= 55 THEN 'MIXED_OR_UNCLEAR' WHEN x <= 74 THEN 'MOSTLY_TRUE' ELSE 'LIKELY_TRUE' END AS band, CASE WHEN x <= 44 THEN 'MOSTLY_FALSE' WHEN x <= 55 THEN 'MIXED_OR_UNCLEAR' ELSE 'MOSTLY_TRUE' END AS failed_band,
    CASE WHEN b >= 1 THEN 'FALSE high_grade_contradiction' WHEN a >= 1 THEN 'TRUE high_grade_support' WHEN m >= 1 OR n >= 1 THEN 'MISLEADING noncurative_relevant_evidence' ELSE 'UNVERIFIABLE no_relevant_evidence' END AS therapeutic
FROM (SELECT o_orderkey, (o_custkey % 120)::DOUBLE AS x, (o_orderkey % 5 = 0)::INT AS a, (o_orderkey % 7 = 0)::INT AS b, (o_custkey % 3 = 0)::INT AS m, (o_custkey % 4 = 0)::INT AS n FROM orders)
""")
def u112_u113_u116_bands(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.session import read_table

    flag = lambda x, n: (F.col(x) % n == 0).cast("int")
    score = (F.col("o_custkey") % 120).cast("double")
    rows = read_table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), scoring.truth_band(score).alias("band"), scoring.untrusted_band(score).alias("failed_band"),
        policy.therapeutic_verdict(flag("o_orderkey", 5), flag("o_orderkey", 7), flag("o_custkey", 3), flag("o_custkey", 4)).alias("t"),
    )
    return rows.select("id", "band", "failed_band", F.concat_ws(" ", "t.verdict", "t.reason").alias("therapeutic"))


# claims with their evidence

PAIRS = f"{CLAIMS_SQL}, {EVIDENCE_SQL}, p AS (SELECT ev.*, claim, c.entities AS asked FROM ev JOIN c USING (claim_id))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return worded.evidence(spark, d).join(worded.claims(spark, d).withColumnRenamed("entities", "asked"), "claim_id")


ANCHOR_LIST = (
    "list_filter(list_concat(" + s_tokens(f"trim(regexp_replace(regexp_replace({s_low('claim')}, '{words.NEGATED_COVERAGE}', ' ', 'g'), '\\s+', ' ', 'g'))", words.HYPHEN, words.STOP, 2)
    + ", " + s_tokens(f"regexp_extract({s_low('claim')}, '{words.OBJECT_OF}', 1)", words.HYPHEN, words.STOP, 2) + f"), lambda w: NOT list_contains({sql_text(words.NO_ANCHOR)}, w))"
)
ANCHORED = f"a0 AS (SELECT *, {ANCHOR_LIST} AS every FROM c), a AS (SELECT claim_id, claim, list_filter(every, lambda w, i: list_position(every, w) = i)[:4] AS anchors FROM a0)"
STRENGTH = f"""
{ANCHORED},
s0 AS (SELECT ev.*, claim, {s_hits('statement', policy.HEDGES)} AS h, {s_hits('statement', policy.UNCERTAIN)} AS un, {s_hits('statement', policy.CONDITIONS)} AS cn, {s_hits('statement', policy.RARE)} AS ra, {s_hits('statement', policy.NARROW)} AS na, {s_hits('statement', policy.FIRM)} AS fi,
    {s_set(s_low('claim'), policy.STRENGTH_TOKEN, policy.STRENGTH_STOP)} AS c_tok, {s_set(s_low('statement'), policy.STRENGTH_TOKEN, policy.STRENGTH_STOP)} AS s_tok, len(anchors) AS n_a, list_count(list_filter(anchors, lambda w: regexp_matches(lower(statement), '(^|[^A-Za-z0-9_])' || w || '($|[^A-Za-z0-9_])'))) AS hit,
    ({s_hits('claim', words.SYMPTOM_PHRASES)} > 0 OR {s_has('claim', words.SYMPTOM_WORDS)}) AND {s_hits('statement', words.NO_SYMPTOMS)} > 0 AS silent FROM ev JOIN a USING (claim_id)),
s1 AS (SELECT *, {_c01('(0.55 * h + 0.35 * un + 0.25 * cn) / 2.0')}::DOUBLE AS hedge, {_c01('(0.65 * ra + 0.35 * na) / 2.0')}::DOUBLE AS rarity, {_c01('0.7 * CASE WHEN coalesce(credibility, 0) = 0 THEN 0.5 ELSE credibility END + 0.3 * least(1, fi / 2.0)')}::DOUBLE AS quality,
    CASE WHEN len(c_tok) > 0 THEN {s_shared('c_tok', 's_tok')} / len(c_tok) ELSE 0 END AS over, CASE WHEN n_a > 0 THEN hit / n_a ELSE 0 END AS share FROM s0),
sg AS (SELECT *, round({_c01('0.45 * over + 0.35 * share + 0.20 * quality - 0.55 * hedge - 0.45 * rarity')}, 4) AS support, CASE stance WHEN 'contradicts' THEN 'REFUTES' WHEN 'entails' THEN 'SUPPORTS' ELSE CASE WHEN {s_has('claim', policy.CLAIM_NEGATED)} = {s_has('statement', policy.TEXT_NEGATED)} THEN 'SUPPORTS' ELSE 'REFUTES' END END AS sd,
    round(CASE WHEN silent THEN 0.5 + 0.5 * share ELSE 0 END, 4)::DOUBLE AS negation_anchor FROM s1)
"""


def _strengths(spark: SparkSession, d: str) -> DataFrame:
    read = ["claim", "statement", "credibility", "stance"]
    return by_value(_pairs(spark, d).select("claim_id", "seq", *read), read, lambda texts: texts.withColumn("strength", policy.strength(*[F.col(x) for x in read]))).select("claim_id", "seq", "strength")


@query(f"WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, {STRENGTH} SELECT claim_id, seq, support, round(hedge, 4) AS hedge, round(rarity, 4) AS rarity, round(quality, 4) AS quality, sd AS stance, negation_anchor FROM sg")
def u48_u49_evidence_strength(spark: SparkSession, d: str) -> DataFrame:
    return _strengths(spark, d).select("claim_id", "seq", "strength.*")


SEGMENTS = ("VALID", "INVALID", "partially_valid", None, "PARTIALLY_INVALID", "UNKNOWN", "STRONGLY_VALID", "INVALID")


@query(f"""
WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, {STRICT}, {STRENGTH},
g AS (SELECT claim_id, count(*) AS n, count(*) FILTER (sd = 'REFUTES') AS nr, coalesce(sum(support) FILTER (sd = 'SUPPORTS'), 0) AS ss, coalesce(sum(support) FILTER (sd = 'REFUTES'), 0) AS sr, coalesce(avg(round(hedge, 4)) FILTER (sd = 'SUPPORTS'), 0) AS hedge,
    coalesce(avg(round(rarity, 4)) FILTER (sd = 'SUPPORTS'), 0) AS rarity, coalesce(avg(support) FILTER (sd = 'REFUTES'), 0) AS refuting, avg(CASE st WHEN 'VALID' THEN 1.0 WHEN 'STRONGLY_VALID' THEN 1.0 WHEN 'PARTIALLY_VALID' THEN 0.5 ELSE 0 END) AS valid,
    avg(CASE st WHEN 'INVALID' THEN 1.0 WHEN 'PARTIALLY_INVALID' THEN 0.5 ELSE 0 END) AS invalid, avg(CASE st WHEN 'UNKNOWN' THEN 1.0 ELSE 0 END) AS open FROM (SELECT *, upper(coalesce({worded.sql_pick(SEGMENTS, 'seq // 100000 + claim_id')}, 'UNKNOWN')) AS st FROM sg) GROUP BY 1),
o AS (SELECT lv.claim_id, lv.is_conditional, lv.is_multi_step, level IN ('HIGH', 'VERY_HIGH') AS high, coalesce(n, 0) AS n, coalesce(nr, 0) AS nr, coalesce(hedge, 0) AS hedge, coalesce(rarity, 0) AS rarity, coalesce(refuting, 0) AS refuting, coalesce(open, 0) AS open,
    CASE o_orderstatus WHEN 'F' THEN 'TRUE' WHEN 'O' THEN 'UNVERIFIABLE' ELSE 'FALSE' END AS said, (o_custkey % 100)::DOUBLE AS truth, (o_custkey % 10) / 10.0::DOUBLE AS conf, (o_custkey % 7) / 7.0::DOUBLE AS div, (o_custkey % 4) / 3.0::DOUBLE AS agr, o_custkey % 6 AS cnt, (o_custkey % 3) / 10.0::DOUBLE AS kg,
    round(greatest(coalesce(valid, 0), {_c01('coalesce(ss, 0) / greatest(1, coalesce(n, 0))')}), 9) AS sup, round(greatest(coalesce(invalid, 0), {_c01('coalesce(sr, 0) / greatest(1, coalesce(n, 0))')}), 9) AS ref FROM lv LEFT JOIN g USING (claim_id) JOIN orders ON o_orderkey = claim_id),
r AS (SELECT *, round(CASE WHEN nr > 0 THEN {_c01('least(1.0, nr / greatest(1, cnt)) * div')} ELSE 0 END, 9) AS rdiv FROM o),
f AS (SELECT *, high AND ref >= 0.5 AND rdiv >= 0.35 AS forced, high AND said = 'TRUE' AND (hedge >= 0.45 OR rarity >= 0.4) AND (ref >= 0.25 OR refuting >= 0.45) AS hedged, (is_conditional OR is_multi_step) AND said = 'UNVERIFIABLE' AND sup >= 0.45 AND ref < 0.3 AND least(1.0, sup + least(kg, 0.15)) >= 0.55 AS relaxed,
    greatest(0.05, least(CASE WHEN div < 0.1 THEN 0.7 WHEN div < 0.2 THEN 0.8 ELSE 0.98 END, CASE WHEN cnt < 3 THEN 0.75 ELSE 0.98 END, CASE WHEN agr < 0.7 THEN 0.75 ELSE 0.98 END, CASE WHEN high AND div < 0.2 THEN 0.72 ELSE 0.98 END, conf)) AS capped FROM r)
SELECT claim_id, CASE WHEN forced THEN 'CONTRADICTION_DOMINANCE' WHEN hedged THEN 'HEDGE_MISMATCH' WHEN relaxed THEN 'MULTIHOP_RELAXATION' WHEN capped + 1e-9 < conf THEN 'DIVERSITY_CAP' ELSE 'NONE' END AS override_fired,
    CASE WHEN forced THEN 'FALSE' WHEN hedged THEN CASE WHEN ref >= 0.45 THEN 'FALSE' ELSE 'UNVERIFIABLE' END WHEN relaxed THEN 'PARTIALLY_TRUE' ELSE said END AS verdict, CASE WHEN forced THEN least(truth, 20) WHEN hedged THEN CASE WHEN ref >= 0.45 THEN 20 ELSE 55 END WHEN relaxed THEN greatest(truth, 45) END::DOUBLE AS truthfulness_cap,
    CASE WHEN forced THEN 0.55 END::DOUBLE AS confidence_floor, round(capped, 3)::DOUBLE AS confidence_cap, round(sup, 6)::DOUBLE AS support_coverage, round(ref, 6)::DOUBLE AS refute_coverage, round(rdiv, 6)::DOUBLE AS refute_diversity, round(open, 6)::DOUBLE AS unresolved_ratio, high AS strictness_high, capped + 1e-9 < conf AS cap_fired FROM f
""")
def a19_a20_a21_logic_overrides(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.session import read_table

    c = F.col
    said = F.when(c("o_orderstatus") == "F", "TRUE").when(c("o_orderstatus") == "O", "UNVERIFIABLE").otherwise("FALSE")
    figures = read_table(spark, d, "orders").select(
        c("o_orderkey").alias("claim_id"), said.alias("verdict"), (c("o_custkey") % 100).cast("double").alias("truthfulness"), (c("o_custkey") % 10 / 10.0).alias("confidence"), (c("o_custkey") % 7 / 7.0).alias("diversity"),
        (c("o_custkey") % 4 / 3.0).alias("agreement"), (c("o_custkey") % 6).alias("evidence_count"), (c("o_custkey") % 3 / 10.0).alias("kg_hint"),
    )
    segments = worded.evidence(spark, d).select("claim_id", worded.pick(SEGMENTS, F.floor(c("seq") / 100000) + c("claim_id")).alias("status"))
    rows = logic.overrides(worded.claims(spark, d).select("claim_id", "claim").join(figures, "claim_id"), _strengths(spark, d), segments)
    return rows.withColumns({x: _r(F.col(x)) for x in ("support_coverage", "refute_coverage", "refute_diversity", "unresolved_ratio")})


@query(f"""
WITH {PAIRS}, n AS (SELECT *, {s_has('claim', r'\bhow many\b|\bnumber of\b')} OR ({s_has('claim', policy.COUNT_NUMBER)} AND {s_any('claim', policy.COUNTED)}) AS counts, CASE WHEN quantity > 40 THEN 'count' END AS fact_type FROM p)
SELECT claim_id, seq FROM n WHERE NOT counts OR ({s_has('statement', policy.COUNT_NUMBER)} AND ((side = 'sem' AND fact_type = 'count') OR list_has_any({s_set(s_low('statement'), words.ALPHA)}, {s_set("lower(array_to_string(coalesce(asked, []), ' | '))", words.ALPHA)})))
""")
def f3_count_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).withColumn("fact_type", F.when(F.col("quantity") > 40, "count"))
    return logic.count_gate(rows, worded.claims(spark, d)).select("claim_id", "seq")


@query(f"""
WITH {EVIDENCE_SQL}, x AS (SELECT claim_id, seq, CASE upper(stance) WHEN 'ENTAILS' THEN 1 WHEN 'CONTRADICTS' THEN -1 ELSE 0 END AS side FROM ev WHERE score >= 0.35)
SELECT claim_id, coalesce(string_agg(CASE WHEN side = -1 THEN seq::VARCHAR END, ' ' ORDER BY seq), '') AS contradicting, coalesce(string_agg(CASE WHEN side = 1 THEN seq::VARCHAR END, ' ' ORDER BY seq), '') AS supporting, count(CASE WHEN side = -1 THEN 1 END) AS n_contradicting, count(CASE WHEN side = 1 THEN 1 END) AS n_supporting
FROM (SELECT DISTINCT claim_id FROM ev) LEFT JOIN x USING (claim_id) GROUP BY 1
""")
def a18_sided_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = logic.sided_ids(worded.evidence(spark, d).select("claim_id", F.col("seq").alias("evidence_id"), F.col("score").alias("semantic_score"), "stance"))
    return rows.select("claim_id", *[F.array_join(x, " ").alias(x) for x in ("contradicting", "supporting")], *[F.col(x).cast("long").alias(x) for x in ("n_contradicting", "n_supporting")])


@query(f"WITH {EVIDENCE_SQL} SELECT claim_id, seq FROM ev WHERE score >= 0.4 AND stance = 'contradicts' AND {s_has('statement', policy.EFFICACY)}")
def f1_f27_rationale(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).withColumn("semantic_score", F.col("score"))
    return logic.by_score(logic.rationale(rows, "CONTRADICTS"), "score", 0.0).select("claim_id", "seq")


@query(f"""
WITH {PAIRS}, f AS (SELECT claim_id, seq, statement, {s_set(s_low('statement'), words.ALPHA, words.STOP)} AS own, {s_set(s_low('claim'), words.ALPHA, words.STOP)} AS ct, {s_set("lower(array_to_string(coalesce(asked, []), ' | '))", words.ALPHA, words.STOP)} AS et,
    list_transform(list_filter(coalesce(entities, []), lambda a: a IS NOT NULL), lambda a: list_distinct(list_filter(regexp_extract_all(lower(a), {sql_text(words.ALPHA)}), lambda w: NOT list_contains({sql_text(words.STOP)}, w)))) AS aliases, coalesce(len(entities), 0) AS n_alias,
    list_distinct(regexp_extract_all(lower(coalesce(claim, '') || ' ' || array_to_string(coalesce(asked, []), ' ')), '\\bvitamin\\s+([a-z0-9]+)\\b', 1)) AS cv, list_distinct(regexp_extract_all({s_low('statement')}, '\\bvitamin\\s+([a-z0-9]+)\\b', 1)) AS sv, quantity / 50 AS pm, trust AS ov FROM p)
SELECT claim_id, seq, (list_has_any(own, et) AND ov >= 0.10) OR (list_has_any(own, ct) AND pm >= 0.20) AS on_topic, len(cv) > 0 AND len(sv) > 0 AND NOT list_has_any(cv, sv) AS other_family,
    round(coalesce(list_max(list_transform(aliases, lambda t: CASE WHEN len(t) > 0 THEN len(list_intersect(own, t)) / len(t) ELSE 0 END)), 0), 6)::DOUBLE AS alias_overlap,
    n_alias = 0 OR len(list_filter(aliases, lambda t: len(t) > 0 AND NOT (len(t) = 1 AND list_contains({sql_text(policy.GENERIC)}, t[1])) AND len(list_intersect(own, t)) = len(t))) > 0 AS must_have FROM f
""")
def f16_f17_f18_f19_topic_guards(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = _pairs(spark, d)
    aligned = policy.topic_aligned(c("statement"), c("claim"), c("asked"), c("quantity") / 50, F.lit(0), c("trust"), F.lit(0.0))
    return rows.select(
        "claim_id", "seq", aligned.alias("on_topic"), policy.family_mismatch(c("statement"), c("claim"), c("asked")).alias("other_family"), _r(policy.alias_overlap(c("statement"), c("entities"))).alias("alias_overlap"),
        policy.has_must_have(c("statement"), c("entities")).alias("must_have"),
    )


# what follows the rank

GRADED = f"""
gr AS (SELECT claim_id, statement, source_url, rank, final, CASE WHEN sem > 0 THEN w_sem * sem ELSE 0 END AS sem_score, credibility, ent, recency, kg, over, anchor, pred, sup, con, list_position(['contradicts', 'neutral', 'entails'], 'neutral') AS z FROM ranked),
gg AS (SELECT *, round({_c01('greatest(final, 0.55 * final + 0.25 * sem_score + 0.20 * credibility)')}, 9) AS blend FROM gr),
g2 AS (SELECT *, CASE WHEN blend >= 0.9 THEN 'A+' WHEN blend >= 0.8 THEN 'A' WHEN blend >= 0.7 THEN 'B' WHEN blend >= 0.6 THEN 'C' WHEN blend >= 0.5 THEN 'D' ELSE 'F' END AS grade, CASE WHEN sem_score >= 0.9 THEN 'HIGH' WHEN sem_score >= 0.75 THEN 'GOOD' WHEN sem_score >= 0.6 THEN 'FAIR' WHEN sem_score >= 0.4 THEN 'LOW' ELSE 'NONE' END AS semantic_confidence FROM gg)
"""


@query(f"""
WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, {MERGED}, {CLAIM_SIGNALS}, {RANKED}, {GRADED}
SELECT claim_id, statement, source_url, grade, semantic_confidence, CASE WHEN sem_score <= 0.08 AND kg >= 0.75 AND over < 0.30 AND anchor < 0.40 AND pred < 0.35 THEN 0.15 ELSE 0 END::DOUBLE AS damping,
    concat_ws('; ', CASE WHEN credibility >= 0.75 THEN 'trusted source' WHEN credibility >= 0.5 THEN 'moderate credibility' END, CASE WHEN ent >= 0.7 THEN 'strong entity overlap' WHEN ent >= 0.3 THEN 'some entity match' END) AS reasons FROM g2 WHERE grade <> 'F'
""")
def f2_t5_t8_t9_t10_graded(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = _ranked(spark, d).withColumn("sem_score", c("w_sem") * c("sem"))
    damping = policy.neutral_graph_damping(F.lit("neutral"), c("sem_score"), c("kg"), c("claim_overlap"), c("anchor_match_score"), c("predicate_match"))
    reasons = F.regexp_replace(F.regexp_replace(F.regexp_replace("grade_rationale", r" \([0-9.]+\)", ""), "(^|; )(high|fair) semantic match|(; )?recent source|low confidence across all signals", ""), "^; ", "")
    rows = apart(logic.by_grade(logic.graded(rows), "D"), {"damping": damping, "reasons": reasons}, "sem_score")
    return rows.select("claim_id", "statement", "source_url", "grade", "semantic_confidence", "damping", "reasons")


INFO = "round(0.45 * final + 0.20 * anchor + 0.20 * abs(sup - con) + 0.15 * cred, 9)"


@query(f"""
WITH {EVIDENCE_SQL}, y AS (SELECT claim_id, seq, statement, CASE WHEN trim({s_low('source_url')}) = '' THEN '__no_source__' ELSE trim({s_low('source_url')}) END AS src, array_to_string(list_sort({s_set(s_low('statement'), words.ALPHA, (*words.STOP, 'no', 'not', 'never', 'without', 'cannot', "can't", "doesn't", "don't", "didn't"))}), ' ') AS sig,
    {s_has('statement', words.NEGATED_PHASE)} AS neg, score AS final, weight AS anchor, trust AS sup, quantity / 100 AS con, coalesce(credibility, 0) AS cred FROM ev),
z AS (SELECT claim_id, src, CASE WHEN sig = '' THEN trim(lower(coalesce(statement, ''))) ELSE sig END AS sig, list_sort(list({{'seq': seq, 'neg': neg, 'info': {INFO}, 'final': final}})) AS items FROM y GROUP BY ALL)
SELECT claim_id, list_reduce(items, lambda a, b: CASE WHEN CASE WHEN a.neg = b.neg THEN b.final > a.final WHEN abs(round(b.info - a.info, 9)) <= 0.03 THEN b.neg AND NOT a.neg ELSE round(b.info - a.info, 9) > 0 END THEN b ELSE a END).seq AS seq FROM z
""")
def d13_without_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = worded.evidence(spark, d).select("claim_id", "seq", "statement", "source_url", c("score").alias("final_score"), c("weight").alias("anchor_match_score"), c("trust").alias("support_score"), (c("quantity") / 100).alias("contradict_score"), "credibility")
    return logic.without_conflicts(rows).select("claim_id", "seq")


@query(f"""
WITH {EVIDENCE_SQL}, l AS (SELECT claim_id, string_agg(seq || 'd' || coalesce(source_url, '') || left(coalesce(statement, ''), 400) || chr(10), '' ORDER BY seq) AS t FROM ev GROUP BY 1) SELECT claim_id, sha256('v1' || t) AS snapshot_id FROM l
""")
def a35_a36_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).select("claim_id", F.col("seq").alias("rank"), F.col("seq").alias("evidence_id"), F.lit("d").alias("domain"), "source_url", "statement")
    return logic.fingerprint(rows, "v1")


MAP = f"""
mp AS (SELECT p.*, coalesce(CASE upper(trim({worded.sql_pick(LABELS, 'seq')})) WHEN 'SUPPORTS' THEN 'SUPPORTS' WHEN 'VALID' THEN 'SUPPORTS' WHEN 'CONTRADICTS' THEN 'REFUTES' WHEN 'PARTIALLY_INVALID' THEN 'REFUTES' END, 'NEUTRAL') AS label,
    round({_c01('0.35 * weight + 0.35 * (quantity / 60) + 0.20 * (' + s_has('claim', words.NEGATED_STANCE) + ' <> ' + s_has('statement', words.NEGATED_STANCE) + ')::INT + 0.10 * (1 - least(1, trust))')}, 9) AS stage1,
    {s_set(s_low('claim'), words.ALPHA, logic.READ_STOP)} AS own, {s_set(s_low('statement'), words.ALPHA, logic.READ_STOP)} AS oth, ({s_has('claim', words.NEGATED_NLI)} <> {s_has('statement', words.NEGATED_NLI)})::INT AS m FROM p),
m1 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY (stage1 >= 0.30) DESC, stage1 DESC, seq) <= 5 AND stage1 >= 0.30 AS ver, {s_shared('own', 'oth')} / greatest(1, len(own)) AS o, CASE label WHEN 'SUPPORTS' THEN [0.72, 0.08, 0.20] WHEN 'REFUTES' THEN [0.08, 0.72, 0.20] ELSE [0.25, 0.25, 0.50] END::DOUBLE[] AS pr FROM mp),
m2 AS (SELECT *, {_sig('1.4 * o + 1.8 * m - 1.3')} AS hc, {_sig('1.6 * o + 1.2 * (1 - m) - 1.4')} AS he FROM m1), m3 AS (SELECT *, greatest(0, 1 - greatest(hc, he)) AS hn FROM m2),
m4 AS (SELECT *, CASE WHEN coalesce(claim, '') = '' OR coalesce(statement, '') = '' THEN [0, 0, 1] WHEN len(own) = 0 OR len(oth) = 0 THEN [0.25, 0.25, 0.5] ELSE [he / (he + hc + hn), hc / (he + hc + hn), hn / (he + hc + hn)] END::DOUBLE[] AS rd, CASE WHEN score = 0 AND l3 = 0 THEN pr ELSE [score, 0, l3] END::DOUBLE[] AS gv FROM (SELECT *, CASE WHEN is_backfill THEN 0.0 ELSE 0.2 END AS l3 FROM m3)),
m5 AS (SELECT *, list_transform([1, 2, 3], lambda i: CASE WHEN ver AND rd[i] <> 0 THEN rd[i] ELSE gv[i] END) AS n FROM m4),
m6 AS (SELECT *, [CASE WHEN label = 'REFUTES' AND n[2] >= n[1] THEN least(n[1], 0.22) ELSE n[1] END, CASE WHEN label = 'SUPPORTS' AND n[1] >= n[2] THEN least(n[2], 0.22) ELSE n[2] END, n[3]] AS k FROM m5),
m7 AS (SELECT *, list_transform([1, 2, 3], lambda i: 0.4 * pr[i] + 0.6 * k[i]) AS w3, trust < 1.5 AND least(1, weight) >= 0.05 AND NOT (quantity = 7) AS okk FROM m6)
"""


@query(f"WITH {PAIRS}, {MAP} SELECT claim_id, seq AS evidence_id, label AS relevance, round(stage1, 6) AS stage1, ver AS verified, ver AND n[2] >= 0.45 AS refute_verified, round(w3[1] / list_sum(w3), 6) AS p_support, round(w3[2] / list_sum(w3), 6) AS p_against, round(w3[3] / list_sum(w3), 6) AS p_neutral, okk AS admissible, round(CASE WHEN okk THEN least(1, weight) * CASE WHEN coalesce(credibility, 0) = 0 THEN 0.5 ELSE least(1, credibility) END ELSE 0 END, 6)::DOUBLE AS weight FROM m7")
def a40_j12_u52_u56_u57_evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    ev = worded.evidence(spark, d).select("claim_id", c("seq").alias("evidence_id"), "statement", "source_url", "quantity", "weight", "trust", "credibility", "score", "is_backfill")
    rows = ev.select(
        "claim_id", "evidence_id", F.when(c("quantity") > 25, c("statement")).alias("statement"), F.lit(None).cast("string").alias("source_url"), worded.pick(LABELS, c("evidence_id")).alias("relevance"), c("weight").alias("relevance_score"), (c("quantity") / 60).alias("contradiction_score"),
        c("trust").alias("predicate_match_score"), c("weight").alias("negation_anchor_overlap"), "credibility", F.lit(1.0).alias("scope_alignment"), (c("quantity") == 7).alias("blocked"), c("score").alias("nli_entail"), F.lit(0.0).alias("nli_contradict"), F.when(c("is_backfill"), 0.0).otherwise(0.2).alias("nli_neutral"),
    )
    out = logic.evidence_scores(logic.with_evidence(rows, ev), worded.claims(spark, d))
    return out.select("claim_id", "evidence_id", "relevance", "verified", "refute_verified", "admissible", *[_r(c(x)).alias(x) for x in ("stage1", "p_support", "p_against", "p_neutral", "weight")])
