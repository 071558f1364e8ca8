"""Queries on the coverage of a claim's parts and on adaptive trust; worded.py says what stands for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import words
from plumbline.operators import coverage
from plumbline.plans import worded
from plumbline.plans.claims import _c01
from plumbline.plans.registry import _r, query
from plumbline.plans.worded import EVIDENCE_SQL, s_any, s_has, s_low, s_set, s_shared, s_tokens, sql_pick, sql_text

#: The parts of each of worded.CLAIMS.
PARTS = (
    ("Zinc supplements reduce colds", "the duration of the common cold"), ("Antibiotics do not work against viral infections",), ("Smoking causes lung cancer",), ("Vitamin D prevents fractures", "fractures in older adults"),
    ("vaccines cause autism", " "), ("The receptor pathway lowers blood pressure",), ("Coffee is effective for alertness", "tea helps too"), ("More than 25 percent of adults", "adults sleep less than 7 hours"), ("",), None, ("Vaccines never cause autism",),
    ("fatty liver has noticeable symptoms",), ("people with anemia need iron", "iron treats anemia"), ("Exercise may improve mood",), ("An adult human has 206 bones",), ("How many cells does the liver have",), ("Vitamin C has proven benefits", "Vitamin C cures a cold"),
    ("Garlic is linked to lower cholesterol",), ("Sugar increases the risk of diabetes", "no", "and obesity"),
)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = worded.claims(spark, d).select("claim_id", F.posexplode(worded.pick(PARTS, c("claim_id"))).alias("i", "subclaim"), "entities")
    return rows.select("claim_id", (c("i") + 1).alias("part"), "subclaim", F.when(c("claim_id") % 4 == 0, c("entities")).alias("anchors"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    kind = F.when(c("side") == "kg", "KG")
    return worded.evidence(spark, d).select("claim_id", c("seq").alias("evidence_id"), "statement", "source_url", c("score").alias("semantic_score"), "trust", "stance", kind.alias("candidate_type"), (c("quantity") > 8).alias("on_topic"), F.when(c("quantity") > 12, True).alias("admissible"))


PLAIN = lambda x: f"trim(regexp_replace(regexp_replace({s_low(x)}, '{words.NEGATED_COVERAGE}', ' ', 'g'), '\\s+', ' ', 'g'))"
OBJ = (*words.STOP, *words.VERB_HINTS)
ANCHORS = f"list_filter(list_concat({s_tokens(PLAIN('subclaim'), words.HYPHEN, words.STOP, 2)}, {s_tokens(f'''regexp_extract({s_low('subclaim')}, '{words.OBJECT_OF}', 1)''', words.HYPHEN, words.STOP, 2)}), lambda w: NOT list_contains({sql_text(words.NO_ANCHOR)}, w))"
COVERED = lambda evidence: f"""
pt AS (SELECT o_orderkey AS claim_id, unnest(range(1, len({sql_pick(PARTS, 'o_orderkey')}) + 1)) AS part, unnest({sql_pick(PARTS, 'o_orderkey')}) AS subclaim, CASE WHEN o_orderkey % 4 = 0 THEN {sql_pick(worded.ENTITIES, 'o_orderkey')} END AS anchors FROM orders),
p0 AS (SELECT claim_id, part::INT AS part, subclaim, list_transform(list_filter(coalesce(anchors, []), lambda a: a IS NOT NULL), lambda a: trim(lower(a))) AS given, {ANCHORS} AS every, {s_tokens(s_low('subclaim'), words.HYPHEN, words.STOP, 2)}[:2] AS few, {s_set(s_low('subclaim'), words.HYPHEN, words.STOP)} AS pt,
    {s_set(s_low('subclaim'), words.HYPHEN, OBJ, 3)} AS po, {s_has('subclaim', words.NEGATED_COVERAGE)} AS pn, {s_set(PLAIN('subclaim'), words.HYPHEN, words.STOP)} AS pp FROM pt WHERE trim(coalesce(subclaim, '')) <> ''),
p1 AS (SELECT *, list_filter(every, lambda w, i: list_position(every, w) = i)[:4] AS own FROM p0), p2 AS (SELECT *, CASE WHEN len(given) > 0 THEN given WHEN len(own) > 0 THEN own ELSE few END AS terms FROM p1),
x0 AS (SELECT p2.*, e.evidence_id, statement, trust, {_c01('greatest(coalesce(semantic_score, 0), coalesce(trust, 0))')} AS sem0, list_count(list_filter(terms, lambda w: w <> '' AND CASE WHEN contains(w, ' ') THEN contains(lower(statement), w) ELSE regexp_matches(lower(statement), '(^|[^A-Za-z0-9_])' || w || '($|[^A-Za-z0-9_])') END)) AS hits,
    {s_set(s_low('statement'), words.HYPHEN, words.STOP)} AS st, {s_set(s_low('statement'), words.HYPHEN, OBJ, 3)} AS so, {s_set(PLAIN('statement'), words.HYPHEN, words.STOP)} AS sp, {s_any('statement', words.REFUTATION_CUES)} AS cue, pn <> {s_has('statement', words.NEGATED_COVERAGE)} AS differs, stance = 'contradicts' AS opposes, coalesce(candidate_type, '') = 'KG' AS is_kg
    FROM p2 JOIN {evidence} e USING (claim_id)),
x1 AS (SELECT *, {s_shared('pt', 'st')} / greatest(1, len(pt)) AS lexical, list_has_any(po, so) AS om, CASE WHEN len(terms) > 0 THEN hits / len(terms) ELSE 0 END AS by_anchor, len(pp) > 0 AND len(sp) > 0 AND ({s_shared('pp', 'sp')} >= 2 OR {s_shared('pp', 'sp')} / greatest(1, len(pp)) >= 0.5) AS aligned FROM x0),
x2 AS (SELECT *, greatest(lexical, by_anchor) AS overlap, greatest(0.7 * sem0 + 0.3 * least(1.0, hits / 2), 0.6 * sem0 + 0.4 * greatest(lexical, by_anchor)) AS r0 FROM x1),
x3 AS (SELECT *, CASE WHEN om AND sem0 >= 0.65 THEN least(1, r0 + 0.08) WHEN len(po) > 0 AND NOT om AND sem0 >= 0.75 AND NOT cue THEN 0.85 * r0 ELSE r0 END * CASE WHEN NOT is_kg THEN 1 WHEN hits = 0 THEN 0.7 WHEN hits < 2 THEN 0.85 ELSE 1 END * CASE WHEN opposes THEN 0.3 ELSE 1 END AS r1 FROM x2),
x4 AS (SELECT *, round({_c01('r1')}, 9) AS rel, round(sem0, 9) AS sem FROM x3),
x5 AS (SELECT *, row_number() OVER (PARTITION BY claim_id, part ORDER BY (rel > 0) DESC, CASE WHEN rel > 0 THEN rel ELSE sem END DESC, evidence_id) AS nth FROM x4 WHERE rel > 0 OR sem >= 0.3),
b AS (SELECT p2.claim_id, p2.part, p2.subclaim, len(p2.terms) AS n_anchors, coalesce(x5.evidence_id, -1) AS evidence_id, coalesce(rel, 0) AS rel, coalesce(sem, 0) AS sem, coalesce(overlap, 0) AS overlap, coalesce(hits, 0) AS hits, coalesce(om, false) AS om, coalesce(cue, false) AS cue, coalesce(differs, false) AS differs, coalesce(aligned, false) AS aligned,
    coalesce(opposes, false) AS opposes, coalesce(trust, 0) AS best_trust FROM p2 LEFT JOIN x5 ON x5.claim_id = p2.claim_id AND x5.part = p2.part AND nth = 1),
b1 AS (SELECT *, sem >= 0.8 AND differs AND (om OR cue) AND (aligned OR hits >= 1) AS denied, opposes AND (om OR cue) AS opposed FROM b),
cov AS (SELECT *, CASE WHEN denied THEN 'INVALID' WHEN opposed THEN 'UNKNOWN' WHEN sem >= 0.55 AND (hits >= 2 OR (om AND sem >= 0.8)) THEN 'STRONGLY_VALID' WHEN sem >= 0.30 AND (hits >= 1 OR om) THEN 'PARTIALLY_VALID' ELSE 'UNKNOWN' END AS status FROM b1),
dt AS (SELECT *, CASE status WHEN 'STRONGLY_VALID' THEN 1.0 WHEN 'PARTIALLY_VALID' THEN 0.5 ELSE 0.0 END::DOUBLE AS weight, denied OR opposed AS contradicted FROM cov)
"""  # noqa: E731
ROWS = "er AS (SELECT claim_id, seq AS evidence_id, statement, source_url, score AS semantic_score, trust, stance, CASE WHEN side = 'kg' THEN 'KG' END AS candidate_type, quantity > 8 AS on_topic, CASE WHEN quantity > 12 THEN true END AS admissible FROM ev)"


@query(f"WITH {EVIDENCE_SQL}, {ROWS}, {COVERED('er')} SELECT claim_id, part, subclaim, status, weight, evidence_id, round(rel, 6) AS relevance, round(sem, 6) AS semantic, round(overlap, 6)::DOUBLE AS overlap, hits AS anchors_matched, n_anchors, contradicted FROM dt")
def a6_a7_j11_w9_u27_u29_subclaim_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.covered(_parts(spark, d), _evidence(spark, d)).drop("best_trust", "predicate_match", "target_overlap").withColumns({x: _r(F.col(x)) for x in ("relevance", "semantic", "overlap")})


@query(f"WITH {EVIDENCE_SQL}, {ROWS}, {COVERED('er')} SELECT claim_id, count(*) AS parts, sum(weight) AS weighted, round(sum(weight) / count(*), 6) AS coverage FROM dt GROUP BY 1")
def a5_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.coverage(coverage.covered(_parts(spark, d), _evidence(spark, d))).withColumn("coverage", _r(F.col("coverage")))


URL_DOMAIN = r"CASE WHEN regexp_matches(coalesce(source_url, ''), '(?i)^https?://[^\s/$.?#].[^\s]*$') THEN regexp_replace(lower(regexp_extract(source_url, '://([^/?#]*)', 1)), '^www[.]', '') ELSE '' END"


@query(f"""
WITH {EVIDENCE_SQL}, {ROWS}, gd AS (SELECT *, on_topic AND coalesce(admissible, on_topic) AS good FROM er), tp AS (SELECT * FROM (SELECT *, bool_or(good) OVER (PARTITION BY claim_id) AS any_good FROM gd) WHERE good OR NOT any_good), {COVERED('tp')},
sn AS (SELECT claim_id, count(*) AS n, count(DISTINCT {URL_DOMAIN}) AS u, avg(CASE WHEN stance <> 'contradicts' THEN 1.0 ELSE 0.0 END) AS agr, max(semantic_score) AS top_sem, max(trust) AS top_trust FROM tp GROUP BY 1),
ag AS (SELECT claim_id, count(*) AS parts, round(sum(weight) / count(*), 9) AS cov, count(*) FILTER (status = 'STRONGLY_VALID') AS strong, count(*) FILTER (contradicted) AS bad, avg(rel) AS rel0, avg(best_trust * weight) FILTER (weight > 0 AND best_trust > 0) AS paid FROM dt GROUP BY 1),
f AS (SELECT ag.*, coalesce(n, 0) AS n, round(CASE WHEN coalesce(n, 0) <= 1 THEN 0 WHEN u >= n THEN 1 ELSE {_c01('1 - ln(n / u) / u')} END, 9)::DOUBLE AS div, round(coalesce(agr, 0), 9) AS agr, coalesce(top_sem, 0) AS top_sem, coalesce(top_trust, 0) AS top_trust, round(CASE WHEN bad > 0 THEN greatest(0, rel0 - 0.10 * bad / parts) ELSE rel0 END, 9) AS rel FROM ag LEFT JOIN sn USING (claim_id)),
h AS (SELECT *, CASE WHEN n < 3 AND cov < 0.2 AND NOT (div >= 0.85 AND rel >= 0.75) THEN 'fail_count' WHEN bad = 0 AND cov >= 0.25 AND div >= 0.95 AND agr >= 0.95 THEN 'consensus' WHEN bad = 0 AND strong > 0 AND ((cov >= 0.25 AND div >= 0.75) OR rel >= 0.55) THEN 'adaptive_override'
    WHEN cov >= 0.6 AND agr >= 0.8 THEN 'high_coverage' WHEN cov >= 0.4 AND div >= 0.7 AND agr >= 0.8 THEN 'medium_coverage' ELSE 'fail' END AS rule, bad = 0 AND strong > 0 AND n >= 2 AND ((cov >= 0.35 AND div >= 0.75) OR rel >= 0.6) AS ov,
    CASE WHEN n = 0 THEN 0 ELSE coalesce(paid * (0.5 + 0.5 * cov), top_trust * greatest(0.25, cov)) END AS po FROM f),
i AS (SELECT *, round(CASE WHEN po <= 0 AND cov >= 0.5 AND top_trust > 0 THEN top_trust * cov ELSE po END, 9) AS post, rule NOT LIKE 'fail%' AS passed FROM h),
j AS (SELECT *, passed AND ((NOT (ov AND cov >= 0.65 AND rel >= 0.68 AND top_trust >= 0.58) AND NOT (cov >= 0.95 AND agr >= 0.9) AND bad = 0 AND (post < 0.4 OR top_sem < 0.45 OR top_trust < 0.4)) OR top_trust < 0.15) AS weak FROM i)
SELECT claim_id, parts, round(cov, 6) AS coverage, round(div, 6) AS diversity, round(agr, 6) AS agreement, strong, bad AS contradicted, round(rel, 6) AS relevance, round(post, 6)::DOUBLE AS trust_post, passed AND NOT weak AS enough, rule, CASE WHEN weak THEN 'weak_relevance_guard' WHEN ov THEN 'adaptive_override' WHEN bad > 0 THEN 'strict_contradiction' ELSE 'strict' END AS reason,
    CASE WHEN NOT passed OR weak THEN 'evidence_insufficiency' WHEN post >= 0.8 THEN 'confirmed' WHEN post >= 0.6 THEN 'provisional' ELSE 'revoked' END AS state FROM j
""")
def a8_t17_t18_adaptive_trust(spark: SparkSession, d: str) -> DataFrame:
    rows = coverage.adaptive_trust(_parts(spark, d), _evidence(spark, d))
    return rows.withColumns({x: _r(F.col(x)) for x in ("coverage", "diversity", "agreement", "relevance", "trust_post")})


FEW = (*words.STOP, "could", "would", "should", "can")


@query(f"""
WITH {EVIDENCE_SQL}, pt AS (SELECT o_orderkey AS claim_id, unnest(range(1, len({sql_pick(PARTS, 'o_orderkey')}) + 1)) AS part, unnest({sql_pick(PARTS, 'o_orderkey')}) AS subclaim FROM orders),
t AS (SELECT claim_id, part::INT AS part, seq, greatest(score, trust) AS s, {s_set(s_low('subclaim'), words.RUN, FEW)} AS a, {s_set(s_low('statement'), words.RUN, FEW)} AS b FROM pt JOIN ev USING (claim_id))
SELECT claim_id, part, seq FROM t WHERE {s_shared('a', 'b')} >= 2 AND {s_shared('a', 'b')} / greatest(1, len(a)) >= 0.18 AND s >= 0.38
""")
def f44_evidence_covers_part(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d).join(worded.evidence(spark, d), "claim_id")
    return rows.filter(coverage.covers(F.col("subclaim"), F.col("statement"), F.greatest("score", "trust"))).select("claim_id", "part", "seq")


CONTENT = (*words.STOP, *coverage.MODAL)
OBJECT = s_set(f"regexp_extract({s_low('subclaim')}, {sql_text(words.OBJECT_OF)}, 1)", words.APOSTROPHE, words.STOP, 2)


@query(f"""
WITH {EVIDENCE_SQL}, pt AS (SELECT o_orderkey AS claim_id, unnest(range(1, len({sql_pick(PARTS, 'o_orderkey')}) + 1)) AS part, unnest({sql_pick(PARTS, 'o_orderkey')}) AS subclaim FROM orders),
t AS (SELECT claim_id, part::INT AS part, seq, statement, {s_tokens(s_low('subclaim'), words.APOSTROPHE, CONTENT)} AS a, {s_set(s_low('statement'), words.APOSTROPHE, CONTENT)} AS b, {OBJECT} AS o FROM pt JOIN ev USING (claim_id)),
f AS (SELECT *, list_filter(a, lambda w: NOT list_contains({sql_text(coverage.DENIALS)}, w)) AS f FROM t), h AS (SELECT *, greatest(1, len(f) // 2) AS m FROM f)
SELECT claim_id, part, count(*) AS rows, max(seq) AS last FROM h WHERE NOT {s_has('statement', coverage.MENTIONED)} AND len(f) > 0 AND list_has_any(f[1:m], b) AND list_has_any(CASE WHEN len(f) > m THEN f[m + 1:] ELSE f END, b)
    AND (len(o) = 0 OR list_has_any(o, b)) AND (NOT list_has_any(a, {sql_text(coverage.DENIALS)}) OR list_has_any(b, {sql_text(coverage.DENIALS)})) GROUP BY 1, 2
""")
def f45_lexical_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d).join(worded.evidence(spark, d), "claim_id")
    fits = rows.filter(coverage.lexically_covers(F.col("subclaim"), F.col("statement")))
    return fits.groupBy("claim_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last"))
