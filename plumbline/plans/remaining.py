"""Queries on log writes and reads, calibration artifacts, display and log texts, grounding, and set operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import pages, scoring, search, urls
from plumbline.operators import extraction, verdict
from plumbline.plans import worded
from plumbline.plans.claims import _c01, _sig
from plumbline.plans.extracting import EVERY, LINES, PROFILE, STRONG, TOKS, _lines, _profiled
from plumbline.plans.registry import LOGS, _logs, _r, query
from plumbline.plans.searching import OBJECTS, SUBJECTS, VERBS
from plumbline.plans.worded import sql_pick
from plumbline.session import by_value, read_table, shared_dir
from plumbline.sources import logs

# logs


@query(f"WITH {LOGS} SELECT id, level, module, ts, value FROM g")
def k11_k12_log_append(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/logs-{uuid.uuid4().hex}"
    rows = _logs(spark, d)
    logs.append(rows.filter("id % 2 = 0"), path)
    logs.append(rows.filter("id % 2 = 1"), path)
    return spark.read.parquet(path).select("id", "level", "module", "ts", "value")


@query(f"WITH {LOGS}, s AS (SELECT id, module, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS written FROM g) SELECT id, module, written FROM s WHERE module = 'm7' AND written >= '2024-01-02' AND written <= '2024-01-09T12' ORDER BY written DESC, id LIMIT 30")
def dt4_iso_range(spark: SparkSession, d: str) -> DataFrame:
    rows = _logs(spark, d).select("id", "module", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("written"))
    return logs.iso_range(rows, "written", "2024-01-02", "2024-01-09T12").filter("module = 'm7'").orderBy(F.desc("written"), "id").limit(30)


# scores

KNOTS = {"mode": "piecewise", "knots": [{"x": 0.2, "y": 0.1}, {"x": 0.6, "y": 0.5}, {"x": 0.9, "y": 0.8}], "reliability_bins": [{"min": 0.0, "max": 0.3, "calibrated": 0.25}, {"min": 0.7, "max": 1.0, "calibrated": 0.75}]}


@query(f"""
WITH x AS (SELECT o_orderkey AS id, (o_custkey % 101) / 100.0::DOUBLE AS s, (o_orderkey % 11) / 10.0::DOUBLE AS cov, (o_custkey % 7) / 6.0::DOUBLE AS con, (o_orderkey % 5) / 4.0::DOUBLE AS adm, (o_orderkey % 9) / 8.0::DOUBLE AS qual, (o_custkey % 3) / 2.0::DOUBLE AS depth FROM orders),
m AS (SELECT *, CASE WHEN s <= 0.2 THEN 0.1 WHEN s <= 0.6 THEN 0.5 ELSE 0.8 END::DOUBLE AS k FROM x), b AS (SELECT *, CASE WHEN k <= 0.3 THEN 0.25 WHEN k >= 0.7 THEN 0.75 ELSE k END::DOUBLE AS t, CASE WHEN adm = 0 THEN 1 ELSE adm END AS a, CASE WHEN qual = 0 THEN 0.5 ELSE qual END AS q FROM m),
c AS (SELECT *, 0.62 * t + 0.18 * (0.30 * cov + 0.25 * 0.5 + 0.15 * 0.5 + 0.20 * a + 0.10 * q) + 0.20 * CASE WHEN s = 0 THEN t ELSE s END - 0.35 * con AS v, CASE WHEN s = 0 THEN t ELSE s END AS top FROM b),
d AS (SELECT *, CASE WHEN top >= 0.55 THEN greatest(v, 0.5 * top) ELSE v END AS w FROM c), e AS (SELECT *, CASE WHEN depth >= 0.66 AND q < 0.45 THEN 0.92 * w ELSE w END AS y FROM d), f AS (SELECT *, CASE WHEN con >= 0.6 AND cov < 0.5 THEN least(y, 0.62) ELSE y END AS z FROM e)
SELECT id, round(t, 6) AS mapped, round({_c01('CASE WHEN a < 0.4 THEN 0.85 * z ELSE z END')}, 9)::DOUBLE AS confidence FROM f
""")
def a42_calibration_artifact(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    part = lambda x, n: c(x) % n / float(n - 1)
    rows = read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), part("o_custkey", 101).alias("s"), part("o_orderkey", 11).alias("cov"), part("o_custkey", 7).alias("con"), part("o_orderkey", 5).alias("adm"), part("o_orderkey", 9).alias("qual"), part("o_custkey", 3).alias("depth"))
    sure = verdict.calibrated_confidence(c("s"), c("cov"), F.lit(0.5), F.lit(0.5), c("con"), c("adm"), c("s"), c("qual"), c("depth"), KNOTS)
    return rows.select("id", _r(verdict.mapped_confidence(c("s"), KNOTS)).alias("mapped"), F.round(sure, 9).alias("confidence"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round({_sig('1.35 * l_discount + 1.10 * l_tax + 1.15 * (l_quantity / 50) + 0.55 * 0.5 + 0.40 * 1.0 - 1.85 * (l_tax * 5) - 1.05')}, 6) AS support, round({_sig('1.30 * (l_tax * 5) + 0.70 * (l_quantity / 50) + 0.35 * 0.5 + 0.20 * 1.0 - 0.80 * l_discount - 0.55 * l_tax - 0.85')}, 6) AS against FROM lineitem")
def u59_m1_support_contradiction(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    s, a = scoring.support_contradiction(c("l_tax"), c("l_quantity") / 50, c("l_discount"), F.lit(0.5), c("l_tax") * 5, F.lit(1.0))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _r(s).alias("support"), _r(a).alias("against"))


# texts for people and logs

#: Texts, what is shown of them, what a log holds, the entity phrase, and other forms of the term.
SHOWN = (
    ("Zinc  helps [1, 2] colds (ref 3) -", "Zinc helps  colds", "Zinc  helps [1, 2] colds (ref 3) -", "zinc helps colds ref", "zinc helps [1, 2] colds (ref 3) -s"),
    ("key sk-abcdefghijkl1234 done", "key sk-abcdefghijkl1234 done", "key ***MASKED*** done", "key sk- done", "key sk-abcdefghijkl1234 dones|key sk abcdefghijkl1234 done"),
    ("and the vitamin-c intake that people used", "and the vitamin-c intake that people used", "and the vitamin-c intake that people used", "the vitamin-c intake", "and the vitamin-c intake that people useds|and the vitamin c intake that people used|and the vitamin-c intake that people used"),
    ("colds", "colds", "colds", "colds", "cold"), ("", "", "", "", ""), (None, "", None, "", ""), ("redis://user:pw@host/0", "redis://user:pw@host/0", "***MASKED***", "redis user host", "redis://user:pw@host/0s"),
)
RAW, DISPLAY, LOGGED, PHRASE, FORMS = zip(*SHOWN, strict=True)


@query(f"SELECT o_orderkey AS id, {sql_pick(DISPLAY, 'o_orderkey')} AS display, {sql_pick(LOGGED, 'o_orderkey')} AS logged, {sql_pick(PHRASE, 'o_orderkey')} AS phrase FROM orders")
def u79_u111_u120_texts(spark: SparkSession, d: str) -> DataFrame:
    x = worded.pick(RAW, F.col("o_orderkey"))
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), search.truth_cleaned(x).alias("display"), pages.masked(x).alias("logged"), pages.entity_phrase(x).alias("phrase"))


@query(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS a FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(a, '\[[0-9,\s\-]+\]', '', 'g'), '(?i)\(\s*(?:ref|refs?|citation)\s*[:#]?\s*[0-9,\s\-]+\)', '', 'g'), '^[ \-;,.]+|[ \-;,.]+$', '', 'g') AS x FROM c),
e AS (SELECT doc_id, x, left(x, 220) AS h FROM b), f AS (SELECT *, greatest(CASE WHEN contains(h, '. ') THEN length(h) - strpos(reverse(h), ' .') - 1 ELSE -1 END, CASE WHEN contains(h, '; ') THEN length(h) - strpos(reverse(h), ' ;') - 1 ELSE -1 END) AS p FROM e)
SELECT doc_id, CASE WHEN length(x) <= 220 THEN x WHEN p >= 121 THEN trim(left(x, p + 1)) ELSE rtrim(left(x, 219)) || '…' END AS display FROM f
""")
def u111_display_texts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", search.truth_cleaned(F.col("text")).alias("display"))


@query("SELECT DISTINCT CASE l_suppkey % 4 WHEN 0 THEN 'https://sub.who.int/a' WHEN 1 THEN 'https://www.Example.org:80/' WHEN 2 THEN 'none' END AS url, coalesce(CASE l_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false END, false) AS listed, CASE l_suppkey % 4 WHEN 0 THEN 'sub.who.int' WHEN 1 THEN 'example.org:80' ELSE '' END AS domain FROM lineitem")
def ul5_ul17_ul18_domains(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.tracking import domain_of

    u = worded.pick(("https://sub.who.int/a", "https://www.Example.org:80/", "none", None), F.col("l_suppkey"))
    return read_table(spark, d, "lineitem").select(u.alias("url")).distinct().select("url", urls.domain_in(F.col("url"), ["www.who.int", "nhs.uk"]).alias("listed"), domain_of(F.col("url")).alias("domain"))


# facts and triples

@query(f"""
WITH {LINES}, {PROFILE}, t AS (SELECT seq, statement, pr.*, {sql_pick(SUBJECTS, 'seq // 100000')} AS s, {sql_pick(VERBS, 'seq // 100000')} AS r, {sql_pick(OBJECTS, 'seq // 100000')} AS o FROM ln JOIN pr USING (claim_id)),
u AS (SELECT *, concat_ws(' ', s, r, o, statement) AS every, concat_ws(' ', r, statement) AS said FROM t), v AS (SELECT *, {TOKS('every')} AS own, list_filter([{', '.join(f"CASE WHEN regexp_matches(lower(said), '{p}') THEN '{n}' END" for n, p in extraction.FAMILIES)}], lambda f: f IS NOT NULL) AS kf FROM u)
SELECT claim_id, seq FROM v WHERE (coalesce(claim, '') = '' AND len(et) = 0 AND len(mt) = 0) OR (len(own) > 0 AND CASE WHEN len(mt) > 0 THEN list_has_any(own, mt) OR {STRONG('own', 'must')} WHEN len(et) > 0 THEN list_has_any(own, et) OR {STRONG('own', 'entities')} ELSE true END
    AND (len(ct) = 0 OR len(list_intersect(own, ct)) > 0) AND (len(cf) = 0 OR len(kf) = 0 OR list_has_any(cf, kf) OR len(list_intersect(own, ct)) >= 2))
""")
def f23_claim_aligned_triples(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    place = F.floor(c("seq") / 100000)
    rows = _lines(spark, d).join(extraction.claim_profile(_profiled(spark, d)), "claim_id")
    fits = extraction.claim_aligned(worded.pick(SUBJECTS, place), worded.pick(VERBS, place), worded.pick(OBJECTS, place), c("statement"), c("claim"), c("claim_tokens"), c("entities"), c("entity_tokens"), c("must_have"), c("must_tokens"), c("claim_families"))
    return rows.filter(fits).select("claim_id", "seq")


@query()
def u69_u70_grounded_statements(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = _lines(spark, d)
    source = F.concat_ws(" ", *[F.concat(worded.pick(EVERY, c("claim_id") + i), F.lit(".")) for i in range(6)])
    grounded = {"b": extraction.best_sentence(c("statement"), c("source")), "grounded": extraction.grounded_statement(c("statement"), c("source"))}
    rows = by_value(rows.select("claim_id", "seq", "statement", source.alias("source")), ["statement", "source"], lambda texts: texts.withColumns(grounded))
    return rows.select("claim_id", "seq", "b.sentence", _r(c("b.score")).alias("score"), "grounded")


@query(f"WITH {PROFILE} SELECT claim_id, array_to_string(list_sort(list_distinct(list_concat(ct, et))), ' ') AS either, array_to_string(list_sort(list_intersect(ct, et)), ' ') AS both, array_to_string(list_sort(list_filter(ct, lambda w: NOT list_contains(et, w))), ' ') AS only_claim FROM pr")
def d18_token_set_operators(spark: SparkSession, d: str) -> DataFrame:
    rows = extraction.claim_profile(_profiled(spark, d))
    joined = lambda a: F.array_join(F.array_sort(a), " ")
    return rows.select("claim_id", joined(F.array_union("claim_tokens", "entity_tokens")).alias("either"), joined(F.array_intersect("claim_tokens", "entity_tokens")).alias("both"), joined(F.array_except("claim_tokens", "entity_tokens")).alias("only_claim"))
