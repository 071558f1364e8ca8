"""Queries on verdicts, domain trust, upserts, lists and orders; registry.py says which tables stand in for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import domains
from plumbline.operators import evidence, ingest, lists, trust, verdict
from plumbline.plans.registry import EVIDENCE, LOGS, _logs, _r, _trusted, query
from plumbline.session import read_table


def _c01(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


def _sig(x: str) -> str:
    return f"(1 / (1 + exp(-greatest(-30, least(30, {x})))))"


# verdicts

def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as scored evidence: shares for and against by discount and tax."""
    return read_table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), F.concat(F.lit("https://s"), F.col("l_suppkey"), F.lit(".example/p")).alias("source_url"), (F.col("l_quantity") / 50).alias("weight"),
        (F.col("l_discount") * 8).alias("p_support"), (F.col("l_tax") * 8).alias("p_against"), F.lit(0.1).alias("p_neutral"), (F.col("l_linestatus") == "F").alias("admissible"),
    )


def _mass(spark: SparkSession, d: str) -> DataFrame:
    claims = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") % 100 / 100.0).alias("coverage"), (F.col("o_orderkey") % 10 / 10.0).alias("diversity"))
    return verdict.evidence_mass(_scores(spark, d)).join(claims, "claim_id")


POSTERIORS = f"""
i AS (SELECT l_orderkey AS claim_id, l_suppkey AS host, l_linestatus = 'F' AND l_quantity > 0 AS ok, l_quantity / 50 AS w, l_discount * 8 AS ps, l_tax * 8 AS pr FROM lineitem),
h AS (SELECT claim_id, host, sum(w * ps) AS s, sum(w * pr) AS r FROM i WHERE ok GROUP BY 1, 2),
v AS (SELECT claim_id, max(c) / sum(c) AS agreement FROM (SELECT claim_id, CASE WHEN s - r > 1e-9 THEN 1 WHEN s - r < -1e-9 THEN 2 ELSE 3 END AS side, count(*) AS c FROM h GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT claim_id, count(*) AS n, count(*) FILTER (ok) AS k, sum(w) FILTER (ok) AS w, sum(w * ln(w)) FILTER (ok) AS wl, coalesce(sum(w * ps) FILTER (ok), 0) AS s, coalesce(sum(w * pr) FILTER (ok), 0) AS r, coalesce(sum(w * 0.1::DOUBLE) FILTER (ok), 0) AS u FROM i GROUP BY 1),
m AS (SELECT g.claim_id, round({_c01('s / greatest(1e-9, s + r + u)')}, 9) AS sm, round({_c01('r / greatest(1e-9, s + r + u)')}, 9) AS rm, round({_c01('u / greatest(1e-9, s + r + u)')}, 9) AS nm,
    coalesce({_c01('(ln(w) - wl / w) / ln(greatest(k, 2))')}, 1.0) AS ent, coalesce(agreement, 0.0) AS agr, k / n AS adm, (o_custkey % 100) / 100.0::DOUBLE AS cov, (o_orderkey % 10) / 10.0::DOUBLE AS div
    FROM g LEFT JOIN v USING (claim_id) JOIN orders ON o_orderkey = g.claim_id),
a AS (SELECT *, {_c01('abs(sm - rm)')} AS margin, {_c01('sm + rm')} AS dm, {_c01('greatest(sm, rm)')} AS ds FROM m),
b AS (SELECT *, {_sig('1.45 * cov + 1.10 * div + 1.35 * dm - 0.55 * CASE WHEN dm >= 0.25 THEN least(ent, 0.85) ELSE ent END - 1.05')} AS suff FROM a),
c AS (SELECT *, sm * (suff + greatest(0.35, agr)) / 2 AS t0, rm * (suff + greatest(0.35, agr)) / 2 AS f0, greatest(0, (1 - suff) * (1 - 0.55 * ds) + nm * greatest(0.08, 1 - (0.65 * margin + 0.20 * ds + 0.30 * dm))) AS u0 FROM b),
q AS (SELECT *, {_c01('t0 / greatest(1e-9, t0 + f0 + u0)')} AS pt, {_c01('f0 / greatest(1e-9, t0 + f0 + u0)')} AS pf, {_c01('u0 / greatest(1e-9, t0 + f0 + u0)')} AS pu FROM c),
p AS (SELECT *, {_c01('greatest(pt, pf, pu) * (0.45 + 0.55 * suff) * (1 - 0.22 * ent) * (0.80 + 0.20 * greatest(margin, ds))')} AS raw FROM q)
"""


@query(f"WITH {POSTERIORS} SELECT claim_id, round(pt, 6) AS p_true, round(pf, 6) AS p_false, round(pu, 6) AS p_unverifiable, round(suff, 6) AS sufficiency, round(agr, 6)::DOUBLE AS agreement, round(raw, 6) AS confidence_raw FROM p")
def a15_posteriors(spark: SparkSession, d: str) -> DataFrame:
    names = ("p_true", "p_false", "p_unverifiable", "sufficiency", "agreement", "confidence_raw")
    return verdict.posteriors(_mass(spark, d)).select("claim_id", *[_r(F.col(c)).alias(c) for c in names])


@query(f"""
WITH {POSTERIORS},
e AS (SELECT *, greatest(sm, rm) AS hi, abs(sm - rm) AS gap FROM p),
l AS (SELECT *,
    pt * CASE WHEN gap >= 0.10 AND sm > rm THEN least(1.25, 1 + 0.15 * gap) ELSE 1 END * CASE WHEN sm > rm + 0.05 THEN least(1.35, 1.15 + 0.12 * greatest(0, gap - 0.05)) ELSE 1 END * CASE WHEN hi <= 0.30 THEN 0.95 ELSE 1 END AS t1,
    pf * CASE WHEN gap >= 0.10 AND sm <= rm THEN least(1.25, 1 + 0.15 * gap) ELSE 1 END * CASE WHEN rm > sm + 0.05 THEN least(1.35, 1.15 + 0.12 * greatest(0, gap - 0.05)) ELSE 1 END * CASE WHEN hi <= 0.30 THEN 0.95 ELSE 1 END AS f1,
    pu * CASE WHEN cov < 0.35 OR adm < 0.40 THEN CASE WHEN hi >= 0.55 AND gap >= 0.18 THEN 1.02 WHEN hi >= 0.45 AND gap >= 0.12 THEN 1.05 ELSE 1.10 END ELSE 1 END * CASE WHEN gap <= 0.08 AND hi <= 0.40 THEN 1.12 ELSE 1 END
        * CASE WHEN (sm > rm + 0.05 OR rm > sm + 0.05) AND hi >= 0.45 AND gap >= 0.12 THEN 0.85 ELSE 1 END * CASE WHEN hi <= 0.30 THEN 1.05 ELSE 1 END AS u1 FROM e),
k AS (SELECT *, {_c01('t1 / (t1 + f1 + u1)')} AS ct, {_c01('f1 / (t1 + f1 + u1)')} AS cf, {_c01('u1 / (t1 + f1 + u1)')} AS cu FROM l),
x AS (SELECT *, greatest(ct, cf, cu) AS top, CASE WHEN ct >= 0.40 AND ct >= cf + 0.05 AND ct >= cu + 0.03 AND sm >= 0.28 AND suff >= 0.42 AND adm >= 0.35 THEN 'TRUE'
    WHEN cf >= 0.40 AND cf >= ct + 0.05 AND cf >= cu + 0.03 AND rm >= 0.28 AND suff >= 0.42 AND adm >= 0.35 THEN 'FALSE'
    WHEN cu >= 0.55 AND cu - greatest(ct, cf) >= 0.12 AND (abs(ct - cf) <= 0.10)::INT + (hi <= 0.28)::INT + (suff <= 0.42)::INT + (adm <= 0.30)::INT >= 3 THEN 'UNVERIFIABLE'
    WHEN greatest(ct, cf, cu) >= 0.45 THEN CASE WHEN ct >= cf AND ct >= cu THEN 'TRUE' WHEN cf >= cu THEN 'FALSE' ELSE 'UNVERIFIABLE' END
    WHEN pt >= pf AND pt >= pu THEN 'TRUE' WHEN pf >= pu THEN 'FALSE' ELSE 'UNVERIFIABLE' END AS verdict FROM k),
y AS (SELECT *, CASE WHEN adm = 0 THEN 1.0 ELSE adm END AS ad, {_c01('0.65 * raw + 0.35 * top')} AS seed FROM x),
z AS (SELECT *, 0.62 * seed + 0.18 * (0.30 * cov + 0.25 * agr + 0.15 * div + 0.20 * ad + 0.05) + 0.20 * top - 0.35 * rm AS s1 FROM y),
z2 AS (SELECT *, CASE WHEN top >= 0.55 THEN greatest(s1, 0.5 * top) ELSE s1 END AS s2 FROM z),
z3 AS (SELECT *, CASE WHEN rm >= 0.60 AND cov < 0.50 THEN least(s2, 0.62) ELSE s2 END AS s3 FROM z2),
z4 AS (SELECT *, {_c01('CASE WHEN ad < 0.40 THEN 0.85 * s3 ELSE s3 END')} AS s4 FROM z3)
SELECT claim_id, verdict, round(CASE WHEN verdict <> 'UNVERIFIABLE' THEN s4 WHEN suff < 0.58 OR margin < 0.24 OR adm < 0.50 THEN least(s4, 0.58) WHEN hi >= 0.60 AND abs(ct - cf) >= 0.20 THEN least(s4, 0.62) ELSE s4 END, 6) AS confidence,
    round(CASE verdict WHEN 'TRUE' THEN greatest(55, least(98, 60 + 40 * pt)) WHEN 'FALSE' THEN greatest(2, least(45, 45 * (1 - pf))) ELSE greatest(30, least(60, 45 + 10 * (pt - pf))) END, 6) AS truthfulness,
    round(1 / (1 + exp(-2.5 * (sm - rm))), 9) AS truth_score_binary, CASE WHEN round(1 / (1 + exp(-2.5 * (sm - rm))), 9) >= 0.5 THEN 'TRUE' ELSE 'FALSE' END AS verdict_binary FROM z4
""")
def a41_a42_a43_verdict_policy(spark: SparkSession, d: str) -> DataFrame:
    v = verdict.verdicts(verdict.posteriors(_mass(spark, d)))
    return v.select("claim_id", "verdict", *[_r(F.col(c)).alias(c) for c in ("confidence", "truthfulness")], "truth_score_binary", "verdict_binary")


@query("""
WITH s AS (SELECT l_orderkey AS claim_id, CASE (l_orderkey // 3 + l_linenumber % 3) % 7 WHEN 0 THEN 'VALID' WHEN 1 THEN 'PARTIALLY_VALID' WHEN 2 THEN 'STRONGLY_VALID' WHEN 3 THEN 'INVALID' WHEN 4 THEN 'PARTIALLY_INVALID' WHEN 5 THEN 'UNKNOWN' ELSE 'VALID' END AS st FROM lineitem),
g AS (SELECT claim_id, count(*) AS segments, count(*) FILTER (st = 'UNKNOWN') AS unresolved, avg(CASE st WHEN 'VALID' THEN 1.0 WHEN 'STRONGLY_VALID' THEN 1.0 WHEN 'PARTIALLY_VALID' THEN 0.75 WHEN 'PARTIALLY_INVALID' THEN 0.25 WHEN 'INVALID' THEN 0.2 ELSE 0.45 END) AS truth,
    bool_or(st LIKE '%INVALID') AS inv, bool_or(st IN ('VALID', 'STRONGLY_VALID', 'PARTIALLY_VALID')) AS sup, bool_and(st = 'VALID') AS every FROM s GROUP BY 1)
SELECT claim_id, segments, unresolved, round(truth, 6) AS weighted_truth, round(least(100, 100 * truth + 5, CASE WHEN unresolved > 0 THEN 65 ELSE 100 END, CASE WHEN unresolved = segments THEN 20 ELSE 100 END), 6) AS truthfulness_cap,
    CASE WHEN unresolved = segments THEN 'UNVERIFIABLE' WHEN every THEN 'TRUE' WHEN unresolved > 0 THEN 'PARTIALLY_TRUE' WHEN NOT sup THEN 'FALSE' ELSE 'PARTIALLY_TRUE' END AS verdict FROM g
""")
def a16_reconcile(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("VALID", "PARTIALLY_VALID", "STRONGLY_VALID", "INVALID", "PARTIALLY_INVALID", "UNKNOWN", "VALID")])
    pick = ((F.floor(F.col("l_orderkey") / 3) + F.col("l_linenumber") % 3) % 7).cast("int")
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.get(names, pick).alias("status"))
    return verdict.reconciled(rows).select("claim_id", "segments", "unresolved", _r(F.col("weighted_truth")).alias("weighted_truth"), _r(F.col("truthfulness_cap")).alias("truthfulness_cap"), "verdict")


METRICS = f"""{EVIDENCE}, g AS (SELECT claim_id, count(*) AS n, count(DISTINCT host) AS u, round(avg(CASE WHEN stance <> 'contradicts' THEN 1.0 ELSE 0.0 END), 9) AS agr, round(avg(weight), 9) AS cov, round(avg(semantic_score), 9) AS rel,
    count(*) FILTER (stance = 'entails') AS strong, count(*) FILTER (stance = 'contradicts') AS bad FROM k WHERE rank <= 10 GROUP BY 1),
f AS (SELECT *, round(CASE WHEN n <= 1 THEN 0.0 WHEN u >= n THEN 1.0 ELSE greatest(0, least(1, 1 - ln(n / u) / u)) END, 9)::DOUBLE AS div FROM g)"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.trust_ranked(_trusted(spark, d))
    extra = rows.groupBy("claim_id").agg(F.round(F.avg("weight"), 9).alias("coverage"), F.round(F.avg("semantic_score"), 9).alias("relevance"), F.count_if(F.col("stance") == "entails").alias("strong"), F.count_if(F.col("stance") == "contradicts").alias("bad"))
    return evidence.claim_metrics(rows).join(extra, "claim_id").withColumns({c: F.round(c, 9) for c in ("diversity", "agreement")})


@query(f"""
WITH {METRICS} SELECT claim_id, CASE WHEN n < 3 AND cov < 0.20 AND NOT (div >= 0.85 AND rel >= 0.75) THEN false
    ELSE (bad = 0 AND cov >= 0.25 AND div >= 0.95 AND agr >= 0.95) OR (bad = 0 AND strong > 0 AND ((cov >= 0.25 AND div >= 0.75) OR rel >= 0.55)) OR (cov >= 0.60 AND agr >= 0.8) OR (cov >= 0.40 AND div >= 0.7 AND agr >= 0.8) END AS enough FROM f
""")
def f43_sufficiency_gate(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _metrics(spark, d).select("claim_id", verdict.sufficient(c("coverage"), c("diversity"), c("agreement"), c("n"), c("relevance"), c("strong"), c("bad")).alias("enough"))


@query(f"WITH {METRICS} SELECT claim_id, round({_c01('(0.34 * (1 - cov) + 0.22 * (1 - div) + 0.16 * (1 - agr) + 0.40 * abs(rel - 0.5) + 0.08 * (bad > 0)::INT) * CASE WHEN n % 4 >= 2 THEN 0.7 ELSE 1 END * CASE WHEN n % 3 >= 2 THEN 0.8 ELSE 1 END')}, 6)::DOUBLE AS gain FROM f")
def a37_information_gain(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    gain = verdict.information_gain(c("coverage"), c("diversity"), c("agreement"), c("relevance"), c("bad") > 0, c("n") % 4, c("n") % 3)
    return _metrics(spark, d).select("claim_id", _r(gain).alias("gain"))


@query(f"""
WITH i AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS o, (l_returnflag = 'R')::INT AS m FROM lineitem),
p AS (SELECT *, {_sig('1.4 * o + 1.8 * m - 1.3')} AS c, {_sig('1.6 * o + 1.2 * (1 - m) - 1.4')} AS e FROM i), q AS (SELECT *, greatest(0, 1 - greatest(c, e)) AS n FROM p)
SELECT l_orderkey, l_linenumber, round(e / (e + c + n), 6) AS entail, round(c / (e + c + n), 6) AS against, round(n / (e + c + n), 6) AS neutral FROM q
""")
def a40_heuristic_nli(spark: SparkSession, d: str) -> DataFrame:
    e, c, n = verdict.heuristic_nli(F.col("l_discount") * 10, F.col("l_returnflag") == "R")
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(e).alias("entail"), _r(c).alias("against"), _r(n).alias("neutral"))


# domains

def _facts(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as facts; every fifth comes from a trusted host, every eleventh from no URL."""
    url = F.when(F.col("l_partkey") % 11 == 0, "none").when(F.col("l_partkey") % 5 == 0, "https://www.cdc.gov/p").otherwise(F.concat(F.lit("https://www.S"), F.col("l_suppkey"), F.lit(".example:80/p")))
    return read_table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id"), url.alias("source_url"), F.col("l_discount").alias("confidence"))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as decisions on the hosts of suppliers; later ones replace earlier ones."""
    rows = read_table(spark, d, "orders")
    return rows.select(F.concat(F.lit("s"), F.col("o_custkey") % 20 + 1, F.lit(".example")).alias("domain"), (F.col("o_orderstatus") == "F").alias("approved"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("seq"))


VALIDATED = """
w AS (SELECT 's' || (o_custkey % 20 + 1) || '.example' AS domain, arg_max(o_orderstatus = 'F', (o_orderdate, o_orderkey)) AS approved FROM orders GROUP BY 1),
x AS (SELECT l_orderkey || '-' || l_linenumber AS fact_id, CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 5 = 0 THEN 'cdc.gov' ELSE 's' || l_suppkey || '.example' END AS host FROM lineitem),
s AS (SELECT fact_id, host, CASE WHEN host IS NULL THEN 'UNTRUSTED' WHEN host = 'cdc.gov' OR approved THEN 'TRUSTED' WHEN approved IS NOT NULL THEN 'UNTRUSTED' ELSE 'PENDING_DOMAIN_TRUST' END AS validation_state FROM x LEFT JOIN w ON host = domain),
y AS (SELECT *, CASE validation_state WHEN 'TRUSTED' THEN 'CONFIRMED' WHEN 'UNTRUSTED' THEN 'REVOKED' ELSE 'PROVISIONAL' END AS verdict_state FROM s)
"""


@query("SELECT domain, approved FROM (SELECT 's' || (o_custkey % 20 + 1) || '.example' AS domain, arg_max(o_orderstatus = 'F', (o_orderdate, o_orderkey)) AS approved FROM orders GROUP BY 1)")
def k15_k16_domain_decisions(spark: SparkSession, d: str) -> DataFrame:
    return trust.newest_decisions(_decisions(spark, d))


@query(f"WITH {VALIDATED} SELECT fact_id, validation_state, verdict_state FROM y")
def f46_f47_f48_validation(spark: SparkSession, d: str) -> DataFrame:
    return trust.validated(_facts(spark, d), trust.newest_decisions(_decisions(spark, d))).select("fact_id", "validation_state", "verdict_state")


@query(f"WITH {VALIDATED} SELECT fact_id, host AS domain, 'PENDING_DOMAIN_TRUST' AS old_validation_state, 'PROVISIONAL' AS old_verdict_state, validation_state AS new_validation_state, verdict_state AS new_verdict_state FROM y WHERE verdict_state <> 'PROVISIONAL'")
def st9_revalidation(spark: SparkSession, d: str) -> DataFrame:
    pending = _facts(spark, d).withColumns({"validation_state": F.lit("PENDING_DOMAIN_TRUST"), "verdict_state": F.lit("PROVISIONAL")})
    return trust.revalidation_events(pending, trust.newest_decisions(_decisions(spark, d)))


@query("SELECT l_orderkey || '-' || l_linenumber AS fact_id, l_partkey % 11 <> 0 AND l_partkey % 5 = 0 AS trusted, CASE WHEN l_partkey % 11 <> 0 AND l_partkey % 5 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS source_score, CASE WHEN l_partkey % 11 <> 0 AND l_partkey % 5 = 0 THEN 0.95 ELSE 0.5 END::DOUBLE AS credibility FROM lineitem")
def f29_j16_g5_source_trust(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("source_url")
    return _facts(spark, d).select("fact_id", domains.is_trusted(u).alias("trusted"), domains.source_score(u).alias("source_score"), domains.credibility(u).alias("credibility"))


@query("SELECT page_id, NOT regexp_matches(lower(coalesce(url, '')), '[.](pdf|mp3|mp4|mov|avi|zip|exe|pptx|xls|doc)') AS page FROM pages")
def f56_accessible(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", domains.is_page(F.col("url")).alias("page"))


@query()
def a10_trust_interval(spark: SparkSession, d: str) -> DataFrame:
    return trust.trust_interval(evidence.trust_ranked(_trusted(spark, d))).select("claim_id", _r(F.col("ci_low")).alias("ci_low"), _r(F.col("ci_high")).alias("ci_high"))


# upserts

def _triples(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as triples of part and supplier."""
    names = F.array(*[F.lit(x) for x in ("causes", "is linked_to", "does_not_cause", "", "prevents", "lead_to")])
    statement = F.when(F.col("l_tax") > 0.05, "it does not harm").otherwise("it harms")
    stance = F.when(F.col("l_returnflag") == "A", "SUPPORTS").when(F.col("l_returnflag") == "R", "refutes").otherwise(F.when(F.col("l_linenumber") == 1, "SUPPORTS").otherwise("NEUTRAL"))
    return read_table(spark, d, "lineitem").select(
        F.concat(F.lit("Part "), F.col("l_partkey") % 40).alias("subject"), F.get(names, (F.col("l_partkey") % 6).cast("int")).alias("relation"), F.concat(F.lit("Firm "), F.col("l_suppkey") % 7).alias("object"),
        F.col("l_discount").alias("confidence"), stance.alias("stance"), statement.alias("statement"), F.concat(F.lit("https://s"), F.col("l_suppkey"), F.lit(".example")).alias("source_url"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


TRIPLES = """
i AS (SELECT 'Part ' || (l_partkey % 40) AS subject, ['causes', 'is linked_to', 'does_not_cause', '', 'prevents', 'lead_to'][l_partkey % 6 + 1] AS relation, 'Firm ' || (l_suppkey % 7) AS object, l_discount AS confidence,
    CASE WHEN l_returnflag = 'A' THEN 'SUPPORTS' WHEN l_returnflag = 'R' THEN 'refutes' WHEN l_linenumber = 1 THEN 'SUPPORTS' ELSE 'NEUTRAL' END AS stance, l_tax > 0.05 AS negated, 'https://s' || l_suppkey || '.example' AS source_url, l_orderkey * 10 + l_linenumber AS seq FROM lineitem),
k AS (SELECT *, relation <> '' AND stance <> 'NEUTRAL' AND NOT (negated AND relation IN ('causes', 'is linked_to', 'does_not_cause', 'lead_to')) AS ok, left(md5(lower(subject)), 16) || '|' || relation || '|' || left(md5(lower(object)), 16) AS rid FROM i)
"""


@query(f"WITH {TRIPLES} SELECT rid, max(confidence) AS confidence, arg_max(stance, seq) AS polarity FROM k WHERE ok GROUP BY 1")
def k3_k4_merge_relations(spark: SparkSession, d: str) -> DataFrame:
    t = ingest.relations(_triples(spark, d))
    return ingest.merge_relations(t.filter("seq <= 1000"), t.filter("seq > 1000"))


@query(f"WITH {TRIPLES} SELECT count(*) AS attempted, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed FROM k")
def k6_k7_ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingest_counts(_triples(spark, d))


@query(f"WITH {TRIPLES} SELECT DISTINCT rid, source_url FROM k WHERE ok")
def k5_relation_sources(spark: SparkSession, d: str) -> DataFrame:
    return ingest.relation_sources(ingest.relations(_triples(spark, d)))


@query(f"""
WITH {TRIPLES}, n AS (SELECT DISTINCT subject, relation, object, CASE relation WHEN 'is linked_to' THEN 'associated_with' WHEN 'lead_to' THEN 'causes' WHEN 'does_not_cause' THEN 'causes' ELSE relation END AS label FROM k)
SELECT *, CASE WHEN label IN ('causes', 'prevents') THEN 'causal_or_effect' WHEN label = 'associated_with' THEN 'associative' ELSE 'other' END AS kind, CASE WHEN relation = '' THEN subject || ' ' || object ELSE subject || ' ' || replace(relation, '_', ' ') || ' ' || object END || '.' AS statement FROM n
""")
def g2_g3_g6_triple_text(spark: SparkSession, d: str) -> DataFrame:
    t = _triples(spark, d).select("subject", "relation", "object").distinct().withColumn("label", ingest.relation_label(F.col("relation")))
    return t.withColumn("kind", ingest.relation_type(F.col("label"))).withColumn("statement", ingest.triple_statement(F.col("subject"), F.col("relation"), F.col("object")))


@query("SELECT name, segment, balance FROM (SELECT c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_acctbal < 5000) UNION ALL SELECT s_name, 'firm', s_acctbal FROM supplier UNION ALL SELECT c_name, 'firm', 0 FROM customer WHERE c_acctbal >= 5000")
def k1_k2_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = read_table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    rich = old.filter("balance >= 5000").select("name", F.lit("firm").alias("segment"), F.lit(0.0).alias("balance"))
    new = read_table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("firm").alias("segment"), F.col("s_acctbal").alias("balance")).union(rich)
    return ingest.upsert(old, new, "name", "balance")


@query(f"WITH {LOGS} SELECT id, unnest(['logs:all', 'logs:request:' || module, 'logs:level:' || level]) AS channel FROM g")
def k18_channels(spark: SparkSession, d: str) -> DataFrame:
    return ingest.channels(_logs(spark, d).withColumn("request_id", F.col("module"))).select("id", "channel")


# lists and orders

@query("""
WITH w AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n]+', ' ', 'g')), ' ') AS a FROM benchmark)
SELECT item_id, len(list_distinct(a)) AS n_distinct, ceil(len(a) / 4)::BIGINT AS n_chunks, greatest(0, len(a) - 2) AS n_grams, CASE WHEN len(a) >= 3 THEN a[1] || ' ' || a[2] || ' ' || a[3] END AS first_gram, array_to_string(a[-((len(a) - 1) % 4 + 1):], ' ') AS last_chunk FROM w
""")
def d1_d4_d5_g8_lists(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[ \t\n]+", " ")), " ")
    rows = read_table(spark, d, "benchmark").select("item_id", words.alias("a")).withColumns({"c": lists.chunks(F.col("a"), 4), "g": lists.ngrams(F.col("a"), 3)})
    return rows.select("item_id", F.size(F.array_distinct(F.flatten("c"))).cast("long").alias("n_distinct"), F.size("c").cast("long").alias("n_chunks"), F.size("g").cast("long").alias("n_grams"), F.get("g", F.lit(0)).alias("first_gram"), F.array_join(F.element_at("c", -1), " ").alias("last_chunk"))


@query("""
WITH k AS (SELECT p_brand AS key, p_partkey AS seq, p_retailprice AS x, p_type AS src, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT lower(trim(key)) AS key, min(seq) AS seq, count(DISTINCT src) AS sources, round(sum(x * pow(2.0, CASE WHEN i = 1 THEN 1 - n ELSE i - n - 1 END)), 6) AS score FROM k GROUP BY 1
""")
def a25_merge_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lists.merge_candidates(read_table(spark, d, "part"), "p_brand", "p_partkey", "p_retailprice", "p_type").withColumn("score", _r(F.col("score")))


@query("""
WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) = 1 AS new FROM lineitem),
s AS (SELECT *, coalesce(sum(new::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, new DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM f)
SELECT l_orderkey, l_linenumber, l_suppkey FROM s WHERE seen < 3
""")
def w5_s17_until_enough(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return lists.until_enough(rows, "l_orderkey", ["l_linenumber", "l_suppkey"], "l_suppkey", 3)


@query(f"WITH {EVIDENCE} SELECT claim_id, evidence_id, round(trust - lag(trust) OVER (PARTITION BY claim_id ORDER BY evidence_id, trust), 6) + 0.0 AS delta FROM t")
def w6_trust_delta(spark: SparkSession, d: str) -> DataFrame:
    return lists.change(_trusted(spark, d), "claim_id", ["evidence_id", "trust"], "trust", "delta").select("claim_id", "evidence_id", (_r(F.col("delta")) + 0.0).alias("delta"))


@query("""
SELECT module AS domain, event_type AS method, count(*) AS n, round(avg((value > 50)::INT), 6) AS success_rate, round(avg(value), 6) AS latency FROM (SELECT 'm' || (user_id % 50) AS module, event_type, value FROM events) GROUP BY GROUPING SETS ((module, event_type), (module), (event_type))
""")
def a27_a28_fetch_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events").select(F.concat(F.lit("m"), F.pmod("user_id", F.lit(50))).alias("domain"), F.col("event_type").alias("method"), (F.col("value") > 50).alias("success"), F.col("value").alias("latency"))
    return lists.fetch_statistics(rows).withColumns({"success_rate": _r(F.col("success_rate")), "latency": _r(F.col("latency"))})


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j17_unprocessed(spark: SparkSession, d: str) -> DataFrame:
    done = read_table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return read_table(spark, d, "part").select("p_partkey").join(done, "p_partkey", "left_anti")
