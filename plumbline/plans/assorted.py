"""Queries on stances, frames, stop rules, page addresses, counts over evidence, and the stores; worded.py says what stands for what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import pages, stance, words
from plumbline.operators import evidence, logic, tracking
from plumbline.plans import worded
from plumbline.plans.claims import _decisions, _triples
from plumbline.plans.covering import PARTS
from plumbline.plans.registry import _r, query
from plumbline.plans.worded import CLAIMS_SQL, EVIDENCE_SQL, s_any, s_has, s_low, s_set, s_shared, sql_pick, sql_text
from plumbline.session import read_table

# stance

TARGETS = lambda clauses: f"list_distinct(list_filter(regexp_extract_all(array_to_string({clauses}, ' | '), {sql_text(words.ALPHA)}), lambda w: NOT list_contains({sql_text(stance.NO_TARGET)}, w)))"
NEG = lambda x: TARGETS(f"regexp_extract_all({s_low(x)}, {sql_text(stance.DENIED)}, 1)")
CLAUSES = lambda x: f"list_transform(list_filter(list_zip(regexp_extract_all({s_low(x)}, {sql_text(stance.SAID)}, 1), regexp_extract_all({s_low(x)}, {sql_text(stance.SAID)}, 2)), lambda z: coalesce(z[1], '') = ''), lambda z: z[2])"
POS = lambda x: TARGETS(f"list_filter(list_transform(flatten(list_transform({CLAUSES(x)}, lambda c: string_split_regex(c, '\\bor\\b|\\band\\b|,'))), lambda p: trim(p)), lambda p: NOT (starts_with(p, 'not ') OR starts_with(p, 'no ') OR starts_with(p, 'never ')))")


@query(f"""
WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, cc AS (SELECT claim_id, claim, {NEG('claim')} AS cn, {POS('claim')} AS cp FROM c), s AS (SELECT DISTINCT statement FROM ev), ss AS (SELECT statement, {NEG('statement')} AS en, {POS('statement')} AS ep FROM s),
a AS (SELECT cc.*, ss.*, ev.seq FROM ev JOIN cc USING (claim_id) JOIN ss ON ss.statement = ev.statement),
b AS (SELECT *, len(list_filter(list_filter(string_split_regex({s_low('claim')}, '\\s+'), lambda w: w <> ''), lambda w: contains({s_low('statement')}, w))) > 0 AS named FROM a)
SELECT claim_id, seq, CASE WHEN list_has_any(cn, ep) OR list_has_any(cp, en) THEN 'contradicts' WHEN list_has_any(cn, en) OR list_has_any(cp, ep) THEN 'entails' WHEN {s_any('statement', stance.AGAINST)} AND named THEN 'contradicts' WHEN {s_any('statement', stance.FOR)} AND named THEN 'entails' ELSE 'neutral' END AS stance FROM b
""")
def u54_u55_stance(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).drop("stance").join(worded.claims(spark, d).select("claim_id", "claim"), "claim_id")
    return rows.select("claim_id", "seq", stance.restanced(F.lit("neutral"), F.col("claim"), F.col("statement")).alias("stance"))


STANCE_SQL = f"CASE WHEN list_has_any(cn, ep) OR list_has_any(cp, en) THEN 'contradicts' WHEN list_has_any(cn, en) OR list_has_any(cp, ep) THEN 'entails' WHEN {s_any('statement', stance.AGAINST)} AND named THEN 'contradicts' WHEN {s_any('statement', stance.FOR)} AND named THEN 'entails' ELSE 'neutral' END"


@query(f"""
WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, cc AS (SELECT claim_id, claim, {NEG('claim')} AS cn, {POS('claim')} AS cp FROM c), s AS (SELECT DISTINCT statement FROM ev), ss AS (SELECT statement, {NEG('statement')} AS en, {POS('statement')} AS ep FROM s),
a AS (SELECT cc.*, ss.*, ev.* EXCLUDE (statement, claim_id) FROM ev JOIN cc USING (claim_id) JOIN ss ON ss.statement = ev.statement),
b AS (SELECT *, len(list_filter(list_filter(string_split_regex({s_low('claim')}, '\\s+'), lambda w: w <> ''), lambda w: contains({s_low('statement')}, w))) > 0 AS named, CASE WHEN seq % 2 = 0 THEN weight END AS sem, CASE WHEN seq % 3 = 0 THEN score END AS fin FROM a),
d AS (SELECT *, CASE WHEN stance = 'neutral' THEN {STANCE_SQL} ELSE stance END AS st FROM b)
SELECT claim_id, seq, statement, source_url, round(coalesce(sem, fin, trust, 0), 6)::DOUBLE AS semantic_score, round(coalesce(fin, trust, 0), 6)::DOUBLE AS trust, st AS stance, CASE st WHEN 'entails' THEN 1 WHEN 'contradicts' THEN -1 ELSE 0 END::DOUBLE AS stance_raw, CASE st WHEN 'entails' THEN 1 WHEN 'contradicts' THEN 0 ELSE 0.5 END::DOUBLE AS stance_mapped, NOT is_backfill AS topic_aligned FROM d
""")
def a39_evidence_items(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = worded.evidence(spark, d).select("claim_id", "seq", c("statement").alias("fact"), "source_url", "published_at", "stance", F.when(c("seq") % 2 == 0, c("weight")).alias("sem_score"), F.when(c("seq") % 3 == 0, c("score")).alias("final_score"), c("trust").alias("score"), (~c("is_backfill")).alias("topic_aligned"))
    items = evidence.evidence_items(rows, worded.claims(spark, d)).withColumn("p", c("score_components"))
    return items.select("claim_id", "seq", "statement", "source_url", *[F.round(x, 6).alias(x) for x in ("semantic_score", "trust")], "stance", "p.stance_raw", "p.stance_mapped", "p.topic_aligned")


@query(f"""
WITH {CLAIMS_SQL} SELECT claim_id, CASE WHEN {s_has('claim', r'\b(cure|cures|treat|treats|therapy|effective against)\b')} THEN 'THERAPEUTIC_EFFICACY' ELSE 'GENERIC' END AS claim_type, CASE WHEN {s_has('claim', r'\b(cure|cures|eradicate|eliminate)\b')} THEN 'STRONG' ELSE 'NORMAL' END AS strength, {s_has('claim', stance.COMPARED)} AS comparative FROM c
""")
def u85_u86_claim_frame(spark: SparkSession, d: str) -> DataFrame:
    return worded.claims(spark, d).select("claim_id", stance.claim_frame(F.col("claim")).alias("f")).select("claim_id", "f.claim_type", "f.strength", "f.comparative")


@query(f"""
WITH {CLAIMS_SQL}, {EVIDENCE_SQL}, r AS (SELECT claim_id, claim, statement, row_number() OVER (PARTITION BY claim_id ORDER BY seq) AS rank FROM ev JOIN c USING (claim_id)),
t AS (SELECT *, {s_set(s_low('claim'), stance.TERM, stance.NO_TERM)} AS a, {s_set(s_low('statement'), stance.TERM)} AS b FROM r WHERE rank <= 10)
SELECT claim_id, count(*) FILTER ({s_has('statement', stance.COMPARES)} AND ({s_has('statement', stance.QUANTIFIED)} OR {s_shared('a', 'b')} >= 2)) AS hits FROM t GROUP BY 1
""")
def a32_comparative_hits(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    ranked = worded.evidence(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy("seq")))
    return tracking.comparative_hits(ranked, worded.claims(spark, d))


@query(f"""
WITH {EVIDENCE_SQL}, p AS (SELECT o_orderkey AS claim_id, unnest({sql_pick(PARTS, 'o_orderkey')}) AS segment FROM orders), s AS (SELECT claim_id, {s_set(s_low('segment'), words.ALPHA)} AS s FROM p), t AS (SELECT claim_id, seq, {s_set(s_low('statement'), words.ALPHA)} AS t FROM ev),
b AS (SELECT claim_id, seq, max({s_shared('s', 't')} / len(s)) AS best FROM t JOIN s USING (claim_id) WHERE len(s) > 0 AND len(t) > 0 GROUP BY 1, 2) SELECT claim_id, count(*) FILTER (round(best, 9) >= 0.35) AS hits FROM b GROUP BY 1
""")
def a31_track_hits(spark: SparkSession, d: str) -> DataFrame:
    segments = worded.claims(spark, d).select("claim_id", F.explode(worded.pick(PARTS, F.col("claim_id"))).alias("segment"))
    return tracking.track_hits(worded.evidence(spark, d), segments)


@query(f"""
WITH {EVIDENCE_SQL}, k AS (SELECT claim_id, lower(trim(coalesce(source_url, ''))) || '|' || trim(regexp_replace(lower(coalesce(statement, '')), '\\s+', ' ', 'g')) AS key FROM ev WHERE stance IN ('entails', 'contradicts') OR greatest(weight, score) >= 0.58)
SELECT claim_id, count(DISTINCT key) AS n, max(key) AS last FROM k WHERE trim(key, '|') <> '' GROUP BY 1
""")
def a33_directional_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).withColumns({"support_score": F.col("weight"), "contradict_score": F.col("score")})
    return tracking.directional_keys(rows).select("claim_id", F.size("keys").cast("long").alias("n"), F.array_max("keys").alias("last"))


STOPS = """
x AS (SELECT o_orderkey AS id, (o_custkey % 100) / 100.0::DOUBLE AS cov, (o_custkey % 11) / 10.0::DOUBLE AS div, (o_orderkey % 21) / 20.0::DOUBLE AS agr, (o_orderkey % 7) / 10.0::DOUBLE AS tr, o_custkey % 3 AS st, o_custkey % 4 AS bad, 1 + o_orderkey % 3 AS parts, o_orderkey % 14 AS urls, o_orderkey % 4 AS z, o_custkey % 5 AS lo, o_orderkey % 5 = 0 AS ther, o_custkey % 9 = 0 AS suf FROM orders),
y AS (SELECT *, greatest(0, least(1, (0.34 * (1 - cov) + 0.22 * (1 - div) + 0.16 * (1 - agr) + 0.20 * 2 * abs(tr - 0.5) + 0.08 * (bad > 0)::INT) * CASE WHEN z >= 2 THEN 0.7 ELSE 1 END * CASE WHEN lo >= 2 THEN 0.8 ELSE 1 END)) AS gain FROM x)
"""


@query(f"""
WITH {STOPS} SELECT id, CASE WHEN urls >= 12 THEN 'url_cap' WHEN suf THEN 'sufficient' WHEN NOT ther AND bad >= parts AND agr >= 0.9 AND div >= 0.6 AND urls >= 6 AND tr <= 0.2 THEN 'stable_contradiction' WHEN ther AND bad > 0 AND st >= 1 THEN 'therapeutic_contradiction' WHEN ther AND cov >= 0.5 AND st >= 1 THEN 'therapeutic_coverage'
    WHEN ther THEN 'continue_therapeutic' WHEN z >= 2 AND round(gain, 9) < 0.15 THEN 'saturated' WHEN lo >= 3 AND urls >= 6 AND round(gain, 9) < 0.18 THEN 'no_gain_expected' WHEN cov >= 0.5 THEN 'continue_insufficient' ELSE 'continue' END AS reason,
    CASE WHEN tr >= 0.55 THEN 'stop_threshold_met' WHEN parts = 1 THEN 'trigger_corrective' WHEN div < 0.02 THEN 'stop_no_improvement' ELSE 'trigger_corrective' END AS action, CASE WHEN tr >= 0.6 THEN 'proceed_to_generation' ELSE 'trigger_corrective_retrieval' END AS decision FROM y
""")
def f42_t16_t22_stop_rules(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.verdict import information_gain

    c = F.col
    rows = read_table(spark, d, "orders").select(
        c("o_orderkey").alias("id"), (c("o_custkey") % 100 / 100.0).alias("cov"), (c("o_custkey") % 11 / 10.0).alias("div"), (c("o_orderkey") % 21 / 20.0).alias("agr"), (c("o_orderkey") % 7 / 10.0).alias("tr"), (c("o_custkey") % 3).alias("st"), (c("o_custkey") % 4).alias("bad"), (1 + c("o_orderkey") % 3).alias("parts"),
        (c("o_orderkey") % 14).alias("urls"), (c("o_orderkey") % 4).alias("z"), (c("o_custkey") % 5).alias("lo"), (c("o_orderkey") % 5 == 0).alias("ther"), (c("o_custkey") % 9 == 0).alias("suf"),
    )
    gain = F.round(information_gain(c("cov"), c("div"), c("agr"), c("tr"), c("bad") > 0, c("z"), c("lo")), 9)
    reason = stance.stop_reason(c("ther"), c("suf"), c("cov"), c("div"), c("agr"), c("tr"), c("st"), c("bad"), c("parts"), c("urls"), gain, c("z"), c("lo"))
    return rows.select("id", reason.alias("reason"), stance.next_action(c("parts"), c("tr"), c("div"), 0.55).alias("action"), stance.decision(c("tr"), 0.6).alias("decision"))


# pages

#: Queries, what is embedded of them, and their keys.
TEXTS = (
    ('site:nih.gov "zinc cold" -reddit', "zinc cold", "site nih gov zinc cold reddit"), ("Vitamin-C (ascorbic); dose: 5%", "Vitamin-C ascorbic dose 5", "vitamin c ascorbic dose 5"), ("  ", "", ""), (None, "", ""), ("flu -opinion -Quora vaccine", "flu vaccine", "flu opinion quora vaccine"), ("a_b*c", "a b c", "a_b c"),
)
ASKED, EMBEDDED, KEYS = zip(*TEXTS, strict=True)


@query(f"SELECT o_orderkey AS id, {sql_pick(EMBEDDED, 'o_orderkey')} AS embedded, {sql_pick(KEYS, 'o_orderkey')} AS key FROM orders")
def u7_u87_search_texts(spark: SparkSession, d: str) -> DataFrame:
    q = worded.pick(ASKED, F.col("o_orderkey"))
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pages.embedding_query(q).alias("embedded"), pages.query_key(q).alias("key"))


#: Addresses: the page key, kind, first value of q, and the domain that is looked up among the trusted ones.
PLACES = (
    ("https://IRIS.who.int//a//b/?utm_x=1&b=2&a=&q=zinc%20cold", "https://iris.who.int/a/b?b=2&q=zinc%20cold", "iris_html", "zinc cold", "iris.who.int"), ("http://www.who.int/x.pdf", "http://www.who.int/x.pdf", "pdf_direct", None, "who.int"), ("https://iris.who.int/server/api/core/bitstreams/1/content?ref=a", "https://iris.who.int/server/api/core/bitstreams/1/content", "who_api_bitstream", None, "iris.who.int"),
    ("https://imsear.searo.who.int/handle/12", "https://imsear.searo.who.int/handle/12", "imsear_download", None, "imsear.searo.who.int"), ("https://user@cdc.gov:8080/p?q=1&q=2#x", "https://user@cdc.gov:8080/p?q=1&q=2", "generic_html", "1", "cdc.gov"), ("", "", "generic_html", None, ""), (None, "", "generic_html", None, ""),
    ("www.nih.gov/x?source=a", "https:www.nih.gov/x", "generic_html", None, "nih.gov"),
)
AT, PAGE_KEY, KIND, FIRST, BARE = zip(*PLACES, strict=True)


@query(f"SELECT o_orderkey AS id, {sql_pick(PAGE_KEY, 'o_orderkey')} AS key, {sql_pick(KIND, 'o_orderkey')} AS kind, {sql_pick(FIRST, 'o_orderkey')} AS first_q, {sql_pick(BARE, 'o_orderkey')} AS domain FROM orders")
def ul6_ul9_ul11_ul13_addresses(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.functions import domains

    u = worded.pick(AT, F.col("o_orderkey"))
    return read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), pages.url_key(u).alias("key"), pages.url_type(u).alias("kind"), pages.query_param(u, "q").alias("first_q"), domains.bare_domain(u).alias("domain"))


@query(r"""
SELECT page_id, regexp_replace(coalesce(url, ''), '[?#].*$', '') AS bare, length(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS n_text, CASE WHEN regexp_extract(html, '(?i)href="([^"]*\.pdf[^"]*)"', 1) <> '' THEN 'pdf' END AS pdf, NULL::TIMESTAMP AS published FROM pages
""")
def ul7_ul14_ul15_dt3_page_parts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = read_table(spark, d, "pages")
    return rows.select("page_id", pages.without_query(c("url")).alias("bare"), F.length(F.trim(F.regexp_replace("html", "<[^>]+>", ""))).alias("n_text"), F.when(pages.pdf_link(c("html"), c("url")).isNotNull(), "pdf").alias("pdf"), pages.publish_date(c("html")).cast("timestamp_ntz").alias("published"))


# facts and stores

@query(f"WITH {EVIDENCE_SQL} SELECT claim_id, round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean, count(*) FILTER (seq % 3 = 0) AS trusted, count(*) FILTER (seq % 3 = 1) AS untrusted, count(*) FILTER (seq % 3 = 2) AS pending FROM ev GROUP BY 1")
def a38_mp1_confidence_summary(spark: SparkSession, d: str) -> DataFrame:
    state = worded.pick(("TRUSTED", "UNTRUSTED", "PENDING_DOMAIN_TRUST"), F.col("seq"))
    rows = tracking.confidence_summary(worded.evidence(spark, d).withColumns({"confidence": F.col("score"), "validation_state": state}))
    return rows.withColumns({x: _r(F.col(x)) for x in ("low", "high", "mean")})


@query("SELECT CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_403' WHEN 2 THEN 'http_500' END AS error_code, count(*) AS n FROM events WHERE value <= 50 AND event_id % 4 <> 3 GROUP BY 1")
def a29_a30_error_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return tracking.error_counts(read_table(spark, d, "events").select((c("value") > 50).alias("success"), worded.pick(("timeout", "http_403", "http_500", None), c("event_id")).alias("error_code")))


@query("SELECT p_brand, string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_partkey) AS listed FROM part GROUP BY 1")
def a24_merged_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "part").withColumn("v", F.col("p_partkey").cast("string"))
    return tracking.merged_groups(rows, "p_brand", "p_partkey", "v").select("p_brand", F.array_join("values", " ").alias("listed"))


@query(f"WITH {EVIDENCE_SQL}, k AS (SELECT claim_id, seq, coalesce({sql_pick(('https://cdc.gov/p', 'https://pubmed.ncbi.nlm.nih.gov/1?a=1&b=2', 'https://cochrane.org/review', 'https://news.example.com/a', 'https://blog.example/b?a=2&a=1&z=1', None, None, 'https://none', 'https://who.int/fact', 'https://sub.nhs.uk/zinc'), '(seq // 100) % 1000')}, md5(lower(trim(coalesce(statement, ''))))) AS key FROM ev) SELECT claim_id, min(seq) AS seq FROM k GROUP BY claim_id, key")
def d15_first_evidence(spark: SparkSession, d: str) -> DataFrame:
    return tracking.keep_first_evidence(worded.evidence(spark, d), "seq", ("claim_id", "seq"))


@query("""
WITH i AS (SELECT lower('Part ' || (l_partkey % 40)) AS subject, lower(['causes', 'is linked_to', 'does_not_cause', '', 'prevents', 'lead_to'][l_partkey % 6 + 1]) AS relation, lower('Firm ' || (l_suppkey % 7)) AS object, 'https://s' || l_suppkey || '.example' AS source_url, l_orderkey * 10 + l_linenumber AS seq, l_discount AS c FROM lineitem)
SELECT subject, relation, object, source_url, max(c) AS confidence, arg_min(seq, (-c, seq)) AS seq FROM i GROUP BY 1, 2, 3, 4
""")
def d9_triples_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.dedup import keep_best

    clean = lambda x: F.lower(F.trim(x)).alias(x)
    rows = _triples(spark, d).select(clean("subject"), clean("relation"), clean("object"), "source_url", "confidence", "seq")
    return keep_best(rows, ["subject", "relation", "object", "source_url"], "confidence", "seq")


INGESTED = f"""
w AS (SELECT 's' || (o_custkey % 20 + 1) || '.example' AS domain, arg_max(o_orderstatus = 'F', (o_orderdate, o_orderkey)) AS approved FROM orders GROUP BY 1),
f AS (SELECT claim_id, seq, statement, stance, CASE WHEN seq % 3 = 0 THEN source_url ELSE 'https://s' || ((seq // 100) % 1000 % 30) || '.example/p' END AS url FROM ev),
g AS (SELECT f.*, CASE WHEN regexp_matches(coalesce(url, ''), '^https?://') THEN regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www[.]', ''), ':.*$', '') END AS host FROM f),
t AS (SELECT g.* FROM g LEFT JOIN w ON host = domain WHERE host IS NOT NULL AND (host IN ('cdc.gov', 'pubmed.ncbi.nlm.nih.gov', 'cochrane.org', 'who.int', 'sub.nhs.uk') OR approved))
"""


def _stored(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    place = F.pmod(F.pmod(F.floor(c("seq") / 100), F.lit(1000)), F.lit(30))
    rows = worded.evidence(spark, d)
    url = F.when(c("seq") % 3 == 0, c("source_url")).otherwise(F.concat(F.lit("https://s"), place, F.lit(".example/p")))
    side = F.when(c("stance") == "entails", " supports").when(c("stance") == "contradicts", "REFUTES").otherwise("")
    return rows.select(F.concat_ws("-", "claim_id", "seq").alias("fact_id"), "statement", url.alias("source_url"), "entities", side.alias("stance"))


@query(f"""
WITH {EVIDENCE_SQL}, {INGESTED} SELECT claim_id || '-' || seq AS fact_id, CASE stance WHEN 'entails' THEN '[SUPPORTS_CLAIM] ' WHEN 'contradicts' THEN '[REFUTES_CLAIM] ' ELSE '' END || statement AS embed_text, CASE stance WHEN 'entails' THEN 'SUPPORTS' WHEN 'contradicts' THEN 'REFUTES' END AS side FROM t
""")
def k1_k14_mp2_vector_rows(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators.trust import newest_decisions

    rows = tracking.vector_rows(_stored(spark, d), newest_decisions(_decisions(spark, d)))
    return rows.select("fact_id", "embed_text", F.col("metadata")["stance"].alias("side"))


@query(f"""
WITH {EVIDENCE_SQL}, x AS (SELECT claim_id || '-' || (seq % 50) AS fact_id, statement, CASE WHEN seq % 4 = 0 THEN 'anatomy' ELSE 'other' END AS topic, seq FROM ev WHERE coalesce(statement, '') <> '')
SELECT fact_id, arg_max(statement, seq) AS statement, arg_max(topic, seq) AS topic FROM x GROUP BY 1
""")
def k2_k21_lexical_upsert(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = worded.evidence(spark, d).select(F.concat_ws("-", "claim_id", c("seq") % 50).alias("fact_id"), "statement", F.when(c("seq") % 4 == 0, "anatomy").alias("topic"), "seq")
    return tracking.lexical_rows(None, rows, "seq").select("fact_id", "statement", "topic")


@query(f"WITH {EVIDENCE_SQL} SELECT DISTINCT source_url FROM ev WHERE coalesce(source_url, '') <> '' AND seq % 4 < 2")
def s3_processed_urls(spark: SparkSession, d: str) -> DataFrame:
    store = worded.evidence(spark, d).withColumn("topic", worded.pick((" Anatomy", "other", "genetics", None), F.col("seq")))
    return tracking.processed_urls(store, ["anatomy"])


RELS = "r AS (SELECT l_partkey % 40 || '|' || (l_suppkey % 7) AS rid, 'p' || (l_partkey % 40) AS subject_id, 'f' || (l_suppkey % 7) AS object_id, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2, 3)"


def _relations(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    ends = [F.concat_ws("|", c("l_partkey") % 40, c("l_suppkey") % 7).alias("rid"), F.concat(F.lit("p"), c("l_partkey") % 40).alias("subject_id"), F.concat(F.lit("f"), c("l_suppkey") % 7).alias("object_id")]
    return read_table(spark, d, "lineitem").groupBy(*ends).agg(F.max("l_discount").alias("confidence"))


@query(f"WITH {RELS} SELECT * FROM r WHERE subject_id IN ('p1', 'p2', 'p3') OR object_id IN ('p1', 'f2') ORDER BY confidence DESC, rid LIMIT 25")
def s6_relations_for_entities(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([("p1",), ("p2",), ("p3",), ("f2",)], "id string")
    return tracking.relations_for(_relations(spark, d), ids, 25)


@query(f"WITH {RELS}, m AS (SELECT o_orderkey AS claim_id, 'p' || (o_custkey % 60) AS e FROM orders UNION SELECT o_orderkey, 'f' || (o_orderkey % 30) FROM orders) SELECT DISTINCT claim_id, rid FROM m JOIN r ON e IN (subject_id, object_id)")
def j6_claim_relations(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    orders = read_table(spark, d, "orders")
    mentions = orders.select(c("o_orderkey").alias("claim_id"), F.concat(F.lit("p"), c("o_custkey") % 60).alias("entity_id")).union(orders.select("o_orderkey", F.concat(F.lit("f"), c("o_orderkey") % 30)))
    return tracking.claim_relations(mentions, _relations(spark, d))


@query("""
WITH x AS (SELECT o_custkey AS claim_id, o_orderkey AS seq, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE '' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS verdict, o_orderdate AS done, (o_orderkey % 2) AS age FROM orders)
SELECT claim_id, arg_max(status, (age, seq)) FILTER (status <> '') AS status, arg_max(verdict, (age, seq)) FILTER (verdict IS NOT NULL) AS verdict, min(done) AS first_seen, arg_max(done, (age, seq)) AS last_seen, count(*) AS writes FROM x GROUP BY 1
""")
def k10_merge_claims(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = read_table(spark, d, "orders").select(c("o_custkey").alias("claim_id"), c("o_orderkey").alias("seq"), F.when(c("o_orderkey") % 3 > 0, c("o_orderpriority")).otherwise("").alias("status"), F.when(c("o_orderkey") % 4 == 0, c("o_orderstatus")).alias("verdict"), c("o_orderdate").alias("processed_at"))
    return tracking.merge_claims(rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1"))


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT label, v AS q FROM v WHERE vec_id % 100 = 0),
p AS (SELECT vec_id, round(list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))), 6) AS c FROM v JOIN q USING (label)) SELECT vec_id AS id, max(c) AS score FROM p GROUP BY 1 HAVING max(c) > 0
""")
def j9_j10_m2_best_cosine(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = read_table(spark, d, "embeddings").select(c("label").alias("claim_id"), c("vec_id").alias("id"), c("embedding").alias("v"))
    return tracking.best_cosine(rows, rows.filter("id % 100 = 0").select("claim_id", c("v").alias("q")))


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s, round(o_totalprice, 2) AS p, o_custkey % 3 AS k FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 7 = 0), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS s, round(o_totalprice, 2) + (o_custkey % 2) AS p, o_custkey % 3 AS k FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 5 = 0)
SELECT id, concat_ws(' ', CASE WHEN a.s IS DISTINCT FROM b.s THEN 's' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'p' END, CASE WHEN a.k IS DISTINCT FROM b.k THEN 'k' END) AS changed, round(b.p - a.p, 2) AS delta_p, b.k - a.k AS delta_k FROM a FULL JOIN b USING (id)
""")
def a44_shadow_diff(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("s"), F.round("o_totalprice", 2).alias("p"), (c("o_custkey") % 3).alias("k"), "o_custkey")
    new = rows.withColumns({"s": F.when(c("id") % 2 == 0, "F").otherwise(c("s")), "p": c("p") + c("o_custkey") % 2}).drop("o_custkey")
    # some orders are new, some are gone; each is in one of the two at least
    out = logic.shadow_diff(rows.drop("o_custkey").filter("id % 5 <> 0 OR id % 7 = 0"), new.filter("id % 7 <> 0 OR id % 5 = 0"), "id")
    return out.select("id", F.array_join("changed", " ").alias("changed"), F.round("delta_p", 2).alias("delta_p"), "delta_k")


@query()
def t3_b7_j18_j19_rank_phase(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.plans.ranking import _ranked

    claims = worded.claims(spark, d).withColumn("must_have", F.slice(F.coalesce("entities", F.array().cast("array<string>")), 1, 1))
    statements = worded.evidence(spark, d).select(F.trim(F.coalesce("statement", F.lit(""))).alias("statement"))
    rows = tracking.rank_phase(_ranked(spark, d), claims, statements=statements)
    return rows.select("claim_id", "statement", "source_url", "stance", "rank", "grade", "core", _r(F.col("final_score")).alias("final_score"), _r(F.col("stage1")).alias("stage1"))


@query()
def u34_u35_u36_u37_u38_u39_u40_w7_claim_segments(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.functions.segments import segmented

    return segmented(worded.claims(spark, d))
