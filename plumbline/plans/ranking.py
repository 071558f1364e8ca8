"""Queries on the hybrid rank, coverage and what follows from them; worded.py says what stands for claims and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import words
from plumbline.operators import hybrid
from plumbline.plans import worded
from plumbline.plans.registry import _r, query
from plumbline.plans.worded import CLAIMS_SQL, EVIDENCE_SQL, s_any, s_has, s_hits, s_low, s_set, s_shared, s_tokens, sql_text

# signals of claims

ANCHORS = (
    "list_filter(list_concat(" + s_tokens(f"trim(regexp_replace(regexp_replace({s_low('claim')}, '{words.NEGATED_COVERAGE}', ' ', 'g'), '\\s+', ' ', 'g'))", words.HYPHEN, words.STOP, 2)
    + ", " + s_tokens(f"regexp_extract({s_low('claim')}, '{words.OBJECT_OF}', 1)", words.HYPHEN, words.STOP, 2) + f"), lambda w: NOT list_contains({sql_text(words.NO_ANCHOR)}, w))"
)
WEIGHTS_SQL = ", ".join(f"CASE claim_type {' '.join(f'WHEN {sql_text(k)} THEN {w[i]}::DOUBLE' for k, w in hybrid.WEIGHTS.items())} END AS w_{s}" for i, s in enumerate(hybrid.SIGNALS))
DIRECTED = f"^(.+?){words.DIRECTION}(.+)$"
CLAIM_SIGNALS = f"""
q0 AS (SELECT claim_id, claim, entities AS asked, CASE {' '.join(f"WHEN {s_has('claim', p)} THEN '{k}'" for k, p in words.CLAIM_TYPES)} ELSE 'general' END AS claim_type, trim({s_low('claim')}) <> '' AS context,
    {s_set(f"regexp_extract({s_low('claim')}, '{words.OBJECT_OF}', 1)", words.APOSTROPHE, words.STOP, 2)} AS objects, {s_set(s_low('claim'), words.APOSTROPHE, words.FOCUS_STOP, 3)} AS focus,
    {s_set(f"regexp_extract(trim({s_low('claim')}), '{DIRECTED}', 1)", words.APOSTROPHE, (*words.STOP, 'risk'), 2)} AS subject,
    {s_set(f"regexp_extract(trim({s_low('claim')}), '{DIRECTED}', 2)", words.APOSTROPHE, (*words.STOP, 'risk'), 2)} AS target,
    list_filter([{', '.join(f"CASE WHEN {s_has('claim', p)} THEN '{k}' END" for k, p in words.ACTIONS)}], lambda a: a IS NOT NULL) AS actions,
    {s_has('claim', words.NEGATED_RANK)} AS negated, {s_has('claim', words.BELIEF_CLAIM)} AS belief, {s_has('claim', words.ASSERTIVE)} AS assertive, {ANCHORS} AS every FROM c),
q AS (SELECT *, list_filter(every, lambda w, i: list_position(every, w) = i)[:4] AS anchors, {WEIGHTS_SQL} FROM q0)
"""


@query(f"WITH {CLAIMS_SQL}, {CLAIM_SIGNALS} SELECT claim_id, claim_type, context, list_sort(objects) AS objects, list_sort(focus) AS focus, list_sort(subject) AS subject, list_sort(target) AS target, array_to_string(actions, ' ') AS actions, negated, belief, array_to_string(anchors, ' ') AS anchors, w_sem, w_quality FROM q")
def u8_u9_u13_u14_u16_u17_u19_u20_u26_claim_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = hybrid.claim_signals(worded.claims(spark, d))
    sets = [F.array_sort(c).alias(c) for c in ("objects", "focus", "subject", "target")]
    return rows.select("claim_id", "claim_type", "context", *sets, F.array_join("actions", " ").alias("actions"), "negated", "belief", F.array_join("anchors", " ").alias("anchors"), "w_sem", "w_quality")


# the merge of both sides

TRUSTED_SQL = "(regexp_matches(coalesce(source_url, ''), '(?i)^https?://(www[.])?(cdc[.]gov|pubmed[.]ncbi[.]nlm[.]nih[.]gov|cochrane[.]org|who[.]int|sub[.]nhs[.]uk)(:|/|$)'))"
MERGED = f"""
m0 AS (SELECT claim_id, trim(coalesce(statement, '')) AS statement, source_url, coalesce(arg_min(coalesce(credibility, CASE WHEN {TRUSTED_SQL} THEN 0.95 ELSE 0.5 END)::DOUBLE, (side = 'kg', seq)), 0)::DOUBLE AS credibility,
    arg_min({{'p': published_at}}, (side = 'kg', seq))['p'] AS published_at, CASE WHEN bool_or(side = 'kg') THEN 'KG' ELSE 'VDB' END AS candidate_type, min((side = 'kg', seq)) AS "at",
    greatest(0.0, coalesce(max(score) FILTER (side = 'sem'), 0.0)) AS sem_raw, greatest(0.0, coalesce(max(score) FILTER (side = 'kg'), 0.0)) AS kg_raw, bool_or(is_backfill) AS is_backfill, list_distinct(flatten(list(coalesce(entities, [])))) AS entities FROM ev GROUP BY ALL),
m1 AS (SELECT *, min(sem_raw) OVER p AS s0, max(sem_raw) OVER p AS s1, min(kg_raw) OVER p AS k0, max(kg_raw) OVER p AS k1 FROM m0 WINDOW p AS (PARTITION BY claim_id)),
m AS (SELECT *, CASE WHEN s1 - s0 <= 1e-9 * s1 THEN sem_raw ELSE (sem_raw - s0) / (s1 - s0) END AS sem, CASE WHEN k1 - k0 <= 1e-9 * k1 THEN kg_raw ELSE (kg_raw - k0) / (k1 - k0) END AS kg FROM m1)
"""


@query(f"WITH {EVIDENCE_SQL}, {MERGED} SELECT claim_id, statement, source_url, round(credibility, 6) AS credibility, published_at, candidate_type, round(sem_raw, 6) AS sem_raw, round(kg_raw, 6) AS kg_raw, is_backfill, array_to_string(list_sort(entities), '|') AS entities, round(sem, 6) AS sem, round(kg, 6) AS kg FROM m")
def j8_w1_u23_merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = hybrid.minmax(hybrid.minmax(hybrid.merged(worded.evidence(spark, d)), "sem_raw", "sem"), "kg_raw", "kg")
    return rows.select("claim_id", "statement", "source_url", "published_at", "candidate_type", "is_backfill", F.array_join("entities", "|").alias("entities"), *[_r(F.col(c)).alias(c) for c in ("credibility", "sem_raw", "kg_raw", "sem", "kg")])


# the rank

ENTITY_WORDS = lambda a: s_set(f"array_to_string({a}, ' | ')", words.ALPHA, words.STOP)
CLEAN = lambda a: f"list_distinct(list_transform(list_filter(coalesce({a}, []), lambda e: coalesce(e, '') <> ''), lambda e: lower(trim(e))))"
HIT = "list_count(list_filter(anchors, lambda a: regexp_matches(lower(statement), '(^|[^A-Za-z0-9_])' || a || '($|[^A-Za-z0-9_])')))"
RANKED = f"""
r0 AS (SELECT m.*, q.*, {s_set(s_low('statement'), words.APOSTROPHE, (), 2)} AS tokens, {s_set(s_low('claim'), words.RUN, words.OVERLAP_STOP)} AS cw, {s_set(s_low('statement'), words.RUN, words.OVERLAP_STOP)} AS sw,
    {CLEAN('asked')} AS qe, {CLEAN('m.entities')} AS ie, list_filter([{', '.join(f"CASE WHEN {s_has('statement', p)} THEN '{k}' END" for k, p in words.ACTIONS)}], lambda a: a IS NOT NULL) AS done,
    {s_has('statement', words.NEGATED_RANK)} AS denied, {s_has('statement', words.REFUTES_OBJECT)} AS refutes, {s_has('statement', words.MENTIONS_CLAIM)} AS mentions, {s_any('statement', words.DOUBT)} AS doubt, {HIT} AS hits,
    CASE WHEN contains({s_low('source_url')}, 'cochrane') THEN 0.95::DOUBLE WHEN {s_any('source_url', ('pubmed.ncbi.nlm.nih.gov', 'pmc.ncbi.nlm.nih.gov'))} THEN 0.88 ELSE 0.5 END AS quality,
    CASE WHEN published_at IS NULL THEN 0.0 ELSE greatest(0, least(1, pow(0.5, floor((epoch(TIMESTAMP '{worded.NOW}') - epoch(published_at)) / 86400) / 365.0))) END AS recency
    FROM m JOIN q USING (claim_id) WHERE NOT {s_any('statement', words.LOW_SIGNAL)}),
r1 AS (SELECT *, {ENTITY_WORDS('qe')} AS qt, {ENTITY_WORDS('ie')} AS it, CASE WHEN len(anchors) > 0 THEN hits / len(anchors) ELSE 0.0 END AS anchor, hits >= least(len(anchors), 2) AS anchor_ok, len(actions) = 0 OR list_has_any(actions, done) AS action_ok, negated <> denied AS conflict,
    {s_shared('objects', 'tokens')} AS o_over, {s_shared('focus', 'tokens')} AS f_over, {s_shared('subject', 'tokens')} AS s_over, {s_shared('target', 'tokens')} AS t_over,
    CASE WHEN len(cw) = 0 OR len(sw) = 0 THEN 0.0 ELSE {s_shared('cw', 'sw')} / len(cw) END AS raw_over FROM r0),
r2 AS (SELECT *, CASE WHEN context AND NOT anchor_ok THEN least(raw_over, 0.20) ELSE raw_over END::DOUBLE AS over, CASE WHEN len(qe) = 0 OR len(ie) = 0 THEN 0.0 WHEN len(qt) = 0 OR len(it) = 0 THEN {s_shared('qe', 'ie')} / len(qe) ELSE greatest({s_shared('qe', 'ie')} / len(qe), {s_shared('qt', 'it')} / len(qt)) END AS ent,
    CASE WHEN ({s_hits('claim', words.SYMPTOM_PHRASES)} > 0 OR {s_has('claim', words.SYMPTOM_WORDS)}) AND {s_hits('statement', words.NO_SYMPTOMS)} > 0 THEN 0.5 + 0.5 * anchor ELSE 0.0 END AS neg_anchor, candidate_type = 'KG' AS is_kg FROM r1),
r3 AS (SELECT *, w_sem * sem + w_kg * kg + w_entity * ent + w_overlap * over + w_recency * recency + w_credibility * credibility + w_quality * quality + 0.05 * greatest(0, (sem >= 0.3)::INT + (kg >= 0.3)::INT + (ent >= 0.3)::INT + (over >= 0.3)::INT - 1)
        + CASE WHEN credibility >= 0.9 THEN 0.3 WHEN credibility >= 0.75 THEN 0.1 ELSE 0 END + 0.07 * neg_anchor + CASE WHEN kg_raw > 0 AND (over >= 0.08 OR NOT context) THEN 0.05 * least(1, kg_raw) ELSE 0 END
        + CASE WHEN kg > 0 AND ent >= 0.34 AND (over >= 0.10 OR NOT context) THEN 0.1 ELSE 0 END + CASE WHEN is_kg AND kg_raw >= 0.4 AND anchor_ok THEN 0.08 ELSE 0 END AS base,
    [CASE WHEN anchor < 0.2 THEN CASE WHEN is_kg THEN 0.5::DOUBLE ELSE 0.25 END ELSE 0 END, CASE WHEN is_backfill AND NOT (ent >= 0.25 OR kg >= 0.55 OR kg_raw >= 0.55) THEN 0.12 ELSE 0 END, CASE WHEN len(actions) > 0 AND NOT action_ok AND sem < 0.95 AND kg_raw < 0.95 THEN 0.2 ELSE 0 END,
     CASE WHEN len(objects) > 0 AND o_over = 0 AND NOT refutes THEN 0.3 ELSE 0 END, CASE WHEN len(focus) > 0 AND f_over <= 1 AND sem < 0.85 AND kg_raw < 0.85 THEN 0.18 ELSE 0 END, CASE WHEN len(subject) > 0 AND s_over = 0 AND sem < 0.9 AND kg_raw < 0.9 THEN 0.25 ELSE 0 END,
     CASE WHEN len(target) > 0 AND t_over = 0 AND sem < 0.9 AND kg_raw < 0.9 THEN 0.2 ELSE 0 END, CASE WHEN len(subject) > 0 AND len(target) > 0 AND s_over = 0 AND t_over = 0 THEN 0.4 ELSE 0 END, CASE WHEN NOT belief AND mentions THEN 0.25 ELSE 0 END] AS pen FROM r2),
r4 AS (SELECT *, least(0.55, list_max(pen) + 0.25 * (list_sum(pen) - list_max(pen))) * CASE WHEN sem >= 0.7 THEN greatest(0.4, 1 - 0.5 * sem) ELSE 1 END AS share, conflict AND over >= 0.45 AS opposed,
    least(0.28, 0.10 + 0.22 * (1 - greatest(0, least(1, 0.55 * CASE WHEN t_over > 0 THEN 1 WHEN o_over > 0 THEN 0.35 ELSE 0 END + 0.45 * anchor)))) AS mismatch, greatest(kg, least(1.0, kg_raw)) AS path,
    CASE WHEN len(actions) > 0 THEN greatest(action_ok::INT::DOUBLE, CASE WHEN over >= 0.2 THEN least(1.0, over) ELSE 0 END) ELSE least(1.0, greatest(over, anchor)) END AS pred FROM r3),
r5 AS (SELECT *, base * CASE WHEN context THEN 1 - share ELSE 1 END * CASE WHEN context AND opposed THEN 1 - mismatch ELSE 1 END * CASE WHEN is_kg AND over >= 0.92 AND anchor >= 0.85 AND sem < 0.15 AND kg_raw >= 0.7 THEN 0.82 ELSE 1 END - CASE WHEN context AND assertive AND doubt THEN 0.12 ELSE 0 END AS t0,
    greatest(0, least(1, 0.3 * pred + 0.2 * CASE WHEN t_over > 0 THEN 1 WHEN o_over > 0 THEN 0.4 ELSE 0 END + 0.15 * quality + 0.15 * greatest(0, least(1, 0.55 * over + 0.45 * anchor)) + 0.2 * path)) * CASE WHEN context AND opposed THEN 0.72 ELSE 1 END AS sup,
    greatest(CASE WHEN len(actions) > 0 AND NOT action_ok THEN 1.0 ELSE 0 END, CASE WHEN opposed THEN 0.75 ELSE 0 END)::DOUBLE AS differs FROM r4),
r6 AS (SELECT *, CASE WHEN sem = 0 AND kg = 0 AND credibility >= 0.9 THEN greatest(t0, 0.2) ELSE t0 END AS total, greatest(0, least(1, 0.38 * greatest(neg_anchor, refutes::INT) + 0.22 * differs + 0.18 * greatest(0, 1 - pred) + 0.22 * CASE WHEN refutes OR differs > 0 THEN path ELSE 0 END)) AS con FROM r5),
r7 AS (SELECT * REPLACE (round(over, 9) AS over, round(ent, 9) AS ent, round(recency, 9) AS recency, round(credibility, 9) AS credibility, round(sup, 9) AS sup, round(con, 9) AS con), round(greatest(0, least(1, 0.92 * greatest(0, least(1, total)) + 0.08 * greatest(sup, con))), 9) AS final FROM r6),
r8 AS (SELECT *, CASE WHEN context THEN NOT (
      (over < 0.15 AND sem < 0.75 AND NOT ((kg >= 0.55 OR kg_raw >= 0.45) AND ent >= 0.2 AND over >= 0.08))
      OR (len(objects) > 0 AND s_over = 0 AND t_over = 0 AND over < 0.4 AND sem < 0.9 AND kg_raw < 0.9 AND NOT refutes)
      OR (len(focus) > 0 AND f_over <= 1 AND over < 0.35 AND sem < 0.9 AND kg_raw < 0.9)
      OR (len(subject) > 0 AND s_over = 0 AND sem < 0.95 AND kg_raw < 0.95) OR (len(target) > 0 AND t_over = 0 AND sem < 0.95 AND kg_raw < 0.95)
      OR (NOT belief AND mentions AND over < 0.6) OR (len(actions) > 0 AND NOT action_ok AND len(target) > 0 AND t_over = 0 AND over < 0.75 AND kg_raw < 0.95)
      OR (len(actions) > 0 AND NOT action_ok AND over < 0.45 AND sem < 0.92 AND kg_raw < 0.92) OR (sem < 0.2 AND over < 0.08 AND ent < 0.2 AND kg_raw < 0.4))
    ELSE NOT (sem = 0 AND kg_raw = 0 AND ent = 0 AND credibility < 0.15 AND final < 0.05) END AS inn FROM r7),
r9 AS (SELECT *, bool_or(inn AND (kg > 0 OR is_kg)) OVER (PARTITION BY claim_id) AS kept_kg, row_number() OVER (PARTITION BY claim_id ORDER BY ((is_kg OR kg_raw > 0) AND NOT inn) DESC, final DESC, "at") AS best FROM r8),
ranked AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY final DESC, credibility DESC, sup DESC, recency DESC, statement, source_url NULLS FIRST) AS rank FROM r9
    WHERE inn OR (NOT kept_kg AND (is_kg OR kg_raw > 0) AND NOT inn AND best = 1 AND (kg_raw >= 0.2 OR final >= 0.08)))
"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.hybrid_rank(worded.evidence(spark, d), worded.claims(spark, d), F.lit(worded.NOW).cast("timestamp_ntz"))


@query(f"WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, {MERGED}, {CLAIM_SIGNALS}, {RANKED} SELECT claim_id, statement, source_url, candidate_type, rank, round(final, 6) AS final_score, round(sup, 6) AS support_score, round(con, 6) AS contradict_score, round(over, 6) AS claim_overlap, round(ent, 6) AS entity_overlap, hits AS anchors_matched FROM ranked")
def t1_f14_f15_f53_hybrid_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranked(spark, d)
    return rows.select("claim_id", "statement", "source_url", "candidate_type", "rank", F.col("anchors_matched").cast("long").alias("anchors_matched"), *[_r(F.col(c)).alias(c) for c in ("final_score", "support_score", "contradict_score", "claim_overlap", "entity_overlap")])
