"""Names of the engine's own queries, their callables and their SQL.

The driver's tables stand in for the engine's entities: documents for facts,
benchmark for claims, embeddings for the vector store, pages for web pages,
events for the log, lineitem for the evidence of claims (orders), and
customer, supplier, nation and region for the graph. Scores are rounded to six
places at the output edge only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scoring, text, urls, words
from plumbline.operators import dedup, evidence, graph, retrieval
from plumbline.plans import worded
from plumbline.session import read_table
from plumbline.sources import logs

Query = Callable[[SparkSession, str], DataFrame]
NOW = "1998-12-01 00:00:00"
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that says the same."""

    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _r(x: Column) -> Column:
    return F.round(x, 6)


# text

NORMAL = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
#: White space of all scripts.
WHITE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
FOLDED = f"trim(regexp_replace(lower(coalesce(text, '')), '{WHITE}', ' ', 'g'))"


@query(rf"SELECT doc_id, {NORMAL} AS normal FROM documents")
def u0_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query(rf"SELECT doc_id, trim(regexp_replace(regexp_replace({NORMAL}, '[*_`#~]', '', 'g'), '\.{{2,}}', '.', 'g')) AS clean FROM documents")
def u2_clean_statement(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.clean_statement(F.col("text")).alias("clean"))


@query("""
WITH h AS (SELECT doc_id, text, left(text, 200) AS h, strpos(reverse(left(text, 200)), ' ') AS p FROM documents)
SELECT doc_id, CASE WHEN length(text) <= 200 THEN text
    WHEN p > 0 AND length(h) - p > 160 THEN trim(left(h, length(h) - p)) || '...' ELSE trim(h) || '...' END AS short FROM h
""")
def u3_truncate_content(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.truncate_content(F.col("text"), 200).alias("short"))


@query("""
SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'),
    '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS plain FROM pages
""")
def u4_remove_html_tags(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", text.remove_tags(F.col("html")).alias("plain"))


@query(r"""
SELECT doc_id, trim(s) AS sentence FROM (
    SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents)
WHERE length(trim(s)) > 10
""")
def u6_extract_sentences(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))


@query(f"SELECT doc_id, 'f_' || left(sha256(rtrim(lower(coalesce(source, '')), '/') || '|' || {FOLDED}), 16) AS fact_id FROM documents")
def d6_fact_id(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", text.fact_id(F.col("text"), F.col("source")).alias("fact_id"))


@query("SELECT c_custkey, left(md5(trim(lower(c_name))), 16) AS entity_id FROM customer")
def k8_entity_id(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select("c_custkey", text.entity_id(F.col("c_name")).alias("entity_id"))


@query("SELECT item_id, regexp_matches(coalesce(text, ''), '[0-9]') AS numeric FROM benchmark")
def u24_has_number(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "benchmark").select("item_id", text.has_number(F.col("text")).alias("numeric"))


@query(f"WITH {worded.EVIDENCE_SQL} SELECT DISTINCT statement, array_to_string(list_sort({worded.s_set(worded.s_low('statement'), words.ALPHA, (*words.STOP, *text.SIGNATURE_NEGATIONS))}), ' ') AS signature FROM ev")
def d14_statement_signature(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).select("statement").distinct()
    return rows.select("statement", text.statement_signature(F.col("statement")).alias("signature"))


# URLs

BARE = r"regexp_replace(coalesce(url, ''), '[?#].*$', '')"
DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www[.]', '')"
VALID = r"regexp_matches(coalesce(url, ''), '(?i)^https?://[^\s/$.?#].[^\s]*$')"


@query(rf"SELECT page_id, lower(regexp_replace(regexp_replace({BARE}, '/+$', ''), '://www[.]', '://')) AS normal FROM pages")
def u1_normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal"))


@query(rf"""
WITH {worded.EVIDENCE_SQL}, u AS (SELECT page_id::VARCHAR AS id, url FROM pages UNION ALL SELECT DISTINCT '', source_url FROM ev),
h AS (SELECT *, {VALID} AS valid, CASE WHEN {VALID} THEN {DOMAIN} END AS domain FROM u)
SELECT id, url, valid, domain, regexp_replace(domain, ':.*$', '') AS host, regexp_extract(domain, '([^.]+[.][^.]+|[^.]+)$', 1) AS root FROM h
""")
def ul2_ul3_ul4_domains(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    own = worded.evidence(spark, d).select(F.lit("").alias("id"), F.col("source_url").alias("url")).distinct()
    rows = read_table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), "url").unionByName(own)
    return rows.select("id", "url", urls.is_valid_url(u).alias("valid"), urls.domain(u).alias("domain"), urls.host(u).alias("host"), urls.root_domain(u).alias("root"))


@query(rf"SELECT n.normal, min(page_id) AS page_id FROM (SELECT page_id, lower(regexp_replace(regexp_replace({BARE}, '/+$', ''), '://www[.]', '://')) AS normal FROM pages) n GROUP BY 1")
def d11_distinct_urls(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal"))
    return pages.groupBy("normal").agg(F.min("page_id").alias("page_id"))


#: What each of worded.URLS is keyed by.
KEYS = (
    "https://cdc.gov/p", "https://pubmed.ncbi.nlm.nih.gov/1?a=1&b=2", "https://cochrane.org/review", "https://news.example.com/a", "https://blog.example/b?a=2&a=1&z=1",
    None, None, "https://none", "https://who.int/fact", "https://sub.nhs.uk/zinc",
)


@query(f"""
SELECT DISTINCT {worded.sql_pick(worded.URLS, 'l_suppkey')} AS url, {worded.sql_pick(KEYS, 'l_suppkey')} AS key FROM lineitem
UNION SELECT url, 'https://' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '://([^#]*)', 1), '^www[.]', ''), '([?&])utm_[a-z]+=[^&]*&?', '\\1'), '[?&]$', ''), '/+([?]|$)', '\\1') FROM pages
""")
def ul8_dedupe_key(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).select(F.col("source_url").alias("url")).union(read_table(spark, d, "pages").select("url")).distinct()
    return rows.select("url", urls.dedupe_key(F.col("url")).alias("key"))


# dedup

@query(f"SELECT min(doc_id) AS doc_id, {FOLDED} AS folded FROM documents GROUP BY 2")
def d7_dedup_folded_text(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("doc_id", text.folded(F.col("text")).alias("folded"))
    return rows.groupBy("folded").agg(F.min("doc_id").alias("doc_id"))


#: Rows alike, folded one after the other: the next one stays if its confidence (0.5 where it has none) beats that of the one held (0 where it has none).
FOLD = "list_reduce(list_sort(list({'seq': seq, 'c': conf})), lambda a, b: CASE WHEN coalesce(a.c, 0) < coalesce(b.c, 0.5) THEN b ELSE a END)"


@query(f"WITH {worded.EVIDENCE_SQL}, f AS (SELECT lower(trim(coalesce(statement, ''))) AS statement, source_url, seq, CASE WHEN is_backfill THEN NULL ELSE score END AS conf FROM ev), g AS (SELECT statement, source_url, {FOLD} AS r FROM f GROUP BY 1, 2) SELECT statement, source_url, r.seq AS seq, r.c AS confidence FROM g")
def d8_facts_by_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).select(F.lower(F.trim(F.coalesce("statement", F.lit("")))).alias("statement"), "source_url", "seq", F.when(~F.col("is_backfill"), F.col("score")).alias("confidence"))
    return dedup.keep_confident(rows, ["statement", "source_url"], "confidence", "seq")


@query(f"WITH {worded.EVIDENCE_SQL}, f AS (SELECT claim_id, lower(trim(coalesce(statement, ''))) AS statement, source_url, seq, score FROM ev) SELECT claim_id, statement, source_url, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, statement, source_url ORDER BY coalesce(score, 0) DESC, seq) AS r FROM f) WHERE r = 1")
def d10_candidates_by_score(spark: SparkSession, d: str) -> DataFrame:
    rows = worded.evidence(spark, d).select("claim_id", F.lower(F.trim(F.coalesce("statement", F.lit("")))).alias("statement"), "source_url", "seq", "score")
    return dedup.keep_best(rows, ["claim_id", "statement", "source_url"], "score", "seq")


@query("""
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1
""")
def d2_d3_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.keep_first(read_table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


# retrieval

@query(r"""
WITH t AS (SELECT item_id AS claim, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}'))) AS term FROM benchmark),
e AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}') AS a FROM documents),
size AS (SELECT count(*) AS n, avg(len(a)) AS mean FROM e),
tf AS (SELECT term, doc, dl, count(*) AS tf FROM (SELECT doc, len(a) AS dl, unnest(a) AS term FROM e) WHERE term IN (SELECT term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT term, doc, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS part FROM tf JOIN df USING (term), size),
h AS (SELECT claim, doc, sum(part) AS score, count(*) AS got FROM s JOIN t USING (term) GROUP BY 1, 2),
w AS (SELECT claim, count(*) AS need FROM t GROUP BY 1),
o AS (SELECT claim, doc, round(-score, 6) AS bm25 FROM h JOIN w USING (claim) WHERE got = need)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY bm25, doc) AS rank FROM o) WHERE rank <= 50
""")
def t2_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_topk(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query("""
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM u),
p AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, round(list_dot_product(q.v, r.v) / (q.size * r.size), 6) AS score FROM n q, n r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS rank FROM p) WHERE rank <= 10
""")
def s1_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = read_table(spark, d, "embeddings")
    return retrieval.cosine_topk(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)


# graph

def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Who lives in which nation, and which nation lies in which region."""
    nation, region = read_table(spark, d, "nation"), read_table(spark, d, "region")
    small = F.broadcast(nation.select("n_nationkey", "n_name"))  # the nations of the world
    people = read_table(spark, d, "customer").join(small, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("subject"), F.lit("lives in").alias("relation"), F.col("n_name").alias("object"), F.lit(0.9).alias("confidence"))
    firms = read_table(spark, d, "supplier").join(small, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("subject"), F.lit("based in").alias("relation"), F.col("n_name").alias("object"), F.lit(0.8).alias("confidence"))
    lands = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("lies in").alias("relation"), F.col("r_name").alias("object"), F.lit(0.7).alias("confidence"))
    return people.union(firms).union(lands)


EDGES = """
e AS (SELECT c_name AS subject, 'lives in' AS relation, n_name AS object, 0.9::DOUBLE AS confidence FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT s_name, 'based in', n_name, 0.8::DOUBLE FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT n_name, 'lies in', r_name, 0.7::DOUBLE FROM nation JOIN region ON n_regionkey = r_regionkey)
"""


@query(f"WITH {EDGES} SELECT DISTINCT e.* FROM e WHERE lower(subject) IN (SELECT lower(n_name) FROM nation) OR lower(object) IN (SELECT lower(n_name) FROM nation)")
def j1_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.one_hop(_edges(spark, d), read_table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query(f"""
WITH {EDGES} SELECT DISTINCT a.subject, a.relation AS relation1, a.object AS middle, b.relation AS relation2, b.object, round(greatest(0.0, least(a.confidence, b.confidence) - 0.15), 6) AS score
FROM e a JOIN e b ON a.object = b.subject WHERE a.subject <> b.object AND lower(a.subject) IN (SELECT lower(s_name) FROM supplier)
""")
def j2_two_hop(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hop(_edges(spark, d), read_table(spark, d, "supplier").select(F.col("s_name").alias("name")))


# evidence

def _evidence(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Order lines as evidence of the claim that is their order, with ``more`` of their columns; one supplier in six has no URL."""
    c = F.col
    stance = F.when(c("l_returnflag") == "A", "entails").when(c("l_returnflag") == "R", "contradicts").otherwise("neutral")
    url = F.concat(F.lit("https://www.S"), "l_suppkey", F.lit(".example:8080/p/?utm_source=a&b="), c("l_linenumber") % 2, F.lit("#x"))
    return read_table(spark, d, "lineitem").select(
        c("l_orderkey").alias("claim_id"), worded.sequence().alias("evidence_id"), (c("l_discount") * 10).alias("semantic_score"),
        F.when(c("l_suppkey") % 12 == 0, None).when(c("l_suppkey") % 12 == 1, "").otherwise(url).alias("source_url"), worded.pick(worded.STATEMENTS, c("l_partkey") + 3 * c("l_orderkey")).alias("statement"), c("l_shipdate").alias("published_at"), stance.alias("stance"),
        (c("l_quantity") / 50).alias("weight"), c("l_discount").alias("support"), c("l_tax").alias("against"), (c("l_linenumber") % 4 != 0).alias("admissible"), *more,
    )


def _trusted(spark: SparkSession, d: str) -> DataFrame:
    return evidence.with_trust(_evidence(spark, d), F.lit(NOW).cast("timestamp_ntz"), F.lit(0.5))


EVIDENCE = f"""
v AS (SELECT l_orderkey AS claim_id, {worded.SEQUENCE_SQL} AS evidence_id, l_discount * 10 AS semantic_score, CASE WHEN l_suppkey % 12 < 2 THEN '' ELSE 's' || l_suppkey || '.example:8080' END AS host,
    CASE WHEN l_suppkey % 12 < 2 THEN md5(lower(trim({worded.sql_pick(worded.STATEMENTS, 'l_partkey + 3 * l_orderkey')}))) ELSE 'https://s' || l_suppkey || '.example/p?b=' || (l_linenumber % 2) END AS key, l_shipdate AS published_at, l_linenumber % 4 <> 0 AS admissible,
    CASE l_returnflag WHEN 'A' THEN 'entails' WHEN 'R' THEN 'contradicts' ELSE 'neutral' END AS stance, l_quantity / 50 AS weight, l_discount AS support, l_tax AS against,
    floor((epoch(TIMESTAMP '{NOW}') - epoch(l_shipdate)) / 86400) AS days FROM lineitem),
t0 AS (SELECT *, CASE WHEN days < 180 THEN 1.0::DOUBLE WHEN days < 365 THEN 0.8 WHEN days < 1095 THEN 0.6 WHEN days < 1825 THEN 0.4 ELSE 0.3 END AS recency_part, CASE stance WHEN 'entails' THEN 1.0::DOUBLE WHEN 'contradicts' THEN 0.0 ELSE 0.5 END AS stance_part FROM v),
t AS (SELECT *, greatest(0, least(1, 0.3::DOUBLE * semantic_score + 0.3::DOUBLE * 0.5::DOUBLE + 0.2::DOUBLE * recency_part + 0.2::DOUBLE * stance_part)) AS trust FROM t0),
o AS (SELECT *, row_number() OVER (PARTITION BY claim_id, key ORDER BY trust DESC, semantic_score DESC, evidence_id) AS nth FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY trust DESC, semantic_score DESC, evidence_id) AS rank FROM o WHERE nth = 1)
"""


@query(f"WITH {EVIDENCE} SELECT claim_id, evidence_id, key, round(trust, 6) AS trust, rank FROM k WHERE rank <= 10")
def t6_trust_ranking(spark: SparkSession, d: str) -> DataFrame:
    return evidence.trust_ranked(_trusted(spark, d)).select("claim_id", "evidence_id", "key", _r(F.col("trust")).alias("trust"), "rank")


@query("""
WITH w AS (SELECT l_orderkey AS claim_id, l_linenumber AS evidence_id, l_quantity AS q, min(l_quantity) OVER c AS lo, max(l_quantity) OVER c AS hi FROM lineitem WINDOW c AS (PARTITION BY l_orderkey))
SELECT claim_id, evidence_id, round(CASE WHEN hi = lo THEN q ELSE (q - lo) / (hi - lo) END, 6) AS norm FROM w
""")
def w1_minmax(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("evidence_id"), "l_quantity")
    return evidence.minmax(rows, "l_quantity", "norm").select("claim_id", "evidence_id", _r(F.col("norm")).alias("norm"))


@query(f"""
WITH {EVIDENCE}, a AS (SELECT *, row_number() OVER (PARTITION BY claim_id, stance = 'contradicts' ORDER BY weight DESC, evidence_id, stance) AS own FROM t),
b AS (SELECT *, CASE WHEN stance = 'contradicts' THEN own <= 1 ELSE own <= 2 END AS first FROM a)
SELECT * FROM (SELECT claim_id, evidence_id, stance, row_number() OVER (PARTITION BY claim_id ORDER BY first DESC, weight DESC, evidence_id, stance) AS pick FROM b) WHERE pick <= 3
""")
def w8_quota_interleave(spark: SparkSession, d: str) -> DataFrame:
    return evidence.quota_selected(_evidence(spark, d), 3, 1, "weight").select("claim_id", "evidence_id", "stance", "pick")


@query(f"""
WITH {EVIDENCE}, g AS (SELECT claim_id, count(*) AS n, count(DISTINCT host) AS u, avg(CASE WHEN stance <> 'contradicts' THEN 1.0 ELSE 0.0 END) AS agreement, sum(trust * trust) AS tt, sum(trust) AS t, sum(semantic_score * trust) AS sem, sum(0.5::DOUBLE * trust) AS src, sum(recency_part * trust) AS rec,
    sum(stance_part * trust) AS sta, count(*) FILTER (stance = 'entails') AS n_entails, count(*) FILTER (stance = 'contradicts') AS n_contradicts, count(*) FILTER (stance = 'neutral') AS n_neutral,
    sum(CASE WHEN stance = 'entails' THEN trust ELSE 0 END) AS ts, sum(CASE WHEN stance = 'contradicts' THEN trust ELSE 0 END) AS tc, sum(CASE WHEN stance = 'neutral' THEN trust ELSE 0 END) AS tn FROM k WHERE rank <= 3 GROUP BY 1),
p AS (SELECT *, round(tt / t, 9) AS post FROM g)
SELECT claim_id, n, round(CASE WHEN n <= 1 THEN 0.0 WHEN u >= n THEN 1.0 ELSE greatest(0, least(1, 1 - ln(n / u) / u)) END, 9)::DOUBLE AS diversity, round(agreement, 9) AS agreement, post AS trust_post, n_entails, n_contradicts, n_neutral,
    CASE WHEN post >= 0.85 THEN 'A+' WHEN post >= 0.75 THEN 'A' WHEN post >= 0.65 THEN 'B' WHEN post >= 0.5 THEN 'C' WHEN post >= 0.35 THEN 'D' ELSE 'F' END AS trust_grade, round(sem / t, 9) AS semantic_mean, round(src / t, 9) AS source_mean, round(rec / t, 9) AS recency_mean, round(sta / t, 9) AS stance_mean,
    round(ts / t, 9) AS support_mass, round(tc / t, 9) AS contradict_mass, round(tn / t, 9) + 0.0 AS uncertain_mass FROM p
""")
def a3_a4_a9_a11_claim_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evidence.claim_metrics(evidence.trust_ranked(_trusted(spark, d), 3))
    rounded = ("diversity", "agreement", "trust_post", "semantic_mean", "source_mean", "recency_mean", "stance_mean", "support_mass", "contradict_mass", "uncertain_mass")
    return m.select("claim_id", "n", "trust_grade", "n_entails", "n_contradicts", "n_neutral", *[(F.round(c, 9) + 0.0).alias(c) for c in rounded])


@query(f"""
WITH {EVIDENCE}, c AS (SELECT claim_id, CASE WHEN host = '' THEN 'unknown' ELSE regexp_replace(host, ':.*', '') END AS domain, count(*) AS n, min(rank) AS r FROM k WHERE rank <= 10 GROUP BY 1, 2),
w AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, r) AS i FROM c)
SELECT claim_id, string_agg(domain, ' ' ORDER BY i) AS domains FROM w WHERE i <= 5 GROUP BY 1
""")
def a9_a34_top_domains(spark: SparkSession, d: str) -> DataFrame:
    return evidence.top_domains(evidence.trust_ranked(_trusted(spark, d))).select("claim_id", F.array_join("domains", " ").alias("domains"))


@query(f"""
WITH {EVIDENCE}, g AS (SELECT claim_id, round(1 - coalesce(product(1 - support * trust) FILTER (admissible), 1), 9) AS support, round(1 - coalesce(product(1 - against * trust) FILTER (admissible), 1), 9) AS against, round(coalesce(sum(trust) FILTER (admissible), 0), 9) AS mass,
    list_sort(list(DISTINCT evidence_id) FILTER (admissible)) AS ids FROM t GROUP BY 1), m AS (SELECT *, round(support - against, 9) AS m FROM g)
SELECT claim_id, support, against, CASE WHEN mass < 0.15 THEN 'UNKNOWN' WHEN m >= 0.22 THEN 'VALID' WHEN m <= -0.22 THEN 'INVALID' WHEN m >= 0.06 THEN 'PARTIALLY_VALID' WHEN m <= -0.06 THEN 'PARTIALLY_INVALID' ELSE 'UNKNOWN' END AS status,
    coalesce(array_to_string(ids, ' '), '') AS evidence_ids FROM m
""")
def a12_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return evidence.noisy_or(_trusted(spark, d)).select("claim_id", "support", "against", "status", F.array_join("evidence_ids", " ").alias("evidence_ids"))


@query(f"""
WITH {EVIDENCE}, g AS (SELECT claim_id, sum(weight) AS s, sum(weight * ln(weight)) AS l, count(*) AS k FROM t WHERE weight > 0 GROUP BY 1)
SELECT claim_id, round(greatest(0, least(1, (ln(s) - l / s) / ln(greatest(k, 2)))), 6) AS entropy FROM g
""")
def a13_weight_entropy(spark: SparkSession, d: str) -> DataFrame:
    return evidence.weight_entropy(_evidence(spark, d), "weight").select("claim_id", _r(F.col("entropy")).alias("entropy"))


@query(f"""
WITH {EVIDENCE}, h AS (SELECT claim_id, host, sum(weight * support) AS s, sum(weight * against) AS r FROM t WHERE weight > 0 GROUP BY 1, 2),
c AS (SELECT claim_id, CASE WHEN s > r + 1e-9 THEN 's' WHEN r > s + 1e-9 THEN 'r' ELSE 'n' END AS side, count(*) AS c FROM h GROUP BY 1, 2)
SELECT claim_id, round(max(c) / sum(c), 6) AS agreement FROM c GROUP BY 1
""")
def a14_vote_agreement(spark: SparkSession, d: str) -> DataFrame:
    return evidence.vote_agreement(_evidence(spark, d)).select("claim_id", _r(F.col("agreement")).alias("agreement"))


#: Orders as rows of a regression run.
VERDICTS = ("TRUE", "false", "Partially_True", "MISLEADING", "unverifiable", "mostly_true", None)
DOMAINS = ("a.org", " B.org ", "c.org", "", "d.org")
REGRESSION = f"""
r AS (SELECT upper(trim({worded.sql_pick(VERDICTS, 'o_orderkey')})) AS e0, upper(trim({worded.sql_pick(VERDICTS, 'o_custkey')})) AS p0, [{worded.sql_pick(DOMAINS, 'o_orderkey')}, {worded.sql_pick(DOMAINS, 'o_orderkey + 1')}] AS want,
    [{', '.join(worded.sql_pick(DOMAINS, f'o_custkey + {i}') for i in range(4))}] AS got FROM orders),
s AS (SELECT CASE WHEN e0 IN ('TRUE', 'PARTIALLY_TRUE', 'MOSTLY_TRUE') THEN 1 WHEN e0 IN ('FALSE', 'PARTIALLY_FALSE', 'MISLEADING') THEN 0 END AS e, CASE WHEN p0 IN ('TRUE', 'PARTIALLY_TRUE', 'MOSTLY_TRUE') THEN 1 WHEN p0 IN ('FALSE', 'PARTIALLY_FALSE', 'MISLEADING') THEN 0 END AS p,
    list_filter(list_transform(want, lambda x: lower(trim(x))), lambda x: x <> '') AS want, list_filter(list_transform(got, lambda x: lower(trim(x))), lambda x: x <> '')[:3] AS got FROM r),
g AS (SELECT count(*) AS n, count(*) FILTER (e = p) AS same, count(*) FILTER (e = 1 AND p = 1) AS tp, count(*) FILTER (e = 0 AND p = 1) AS fp, count(*) FILTER (e = 1 AND p = 0) AS fn,
    sum(len(list_filter(got, lambda x: list_contains(want, x)))) FILTER (len(want) > 0 AND len(got) > 0) AS hits, sum(len(got)) FILTER (len(want) > 0 AND len(got) > 0) AS asked FROM s WHERE e IS NOT NULL AND p IS NOT NULL)
"""


@query(f"WITH {REGRESSION}, m AS (SELECT n::DOUBLE AS samples, round(same / n, 4) AS accuracy, round(2.0 * tp / (2 * tp + fp + fn), 4)::DOUBLE AS f1_true, round(hits / asked, 4)::DOUBLE AS evidence_precision_at_3 FROM g) SELECT *, accuracy >= 0.4 AND f1_true >= 0.4 AND evidence_precision_at_3 >= 0.4 AS passed FROM m")
def a22_a23_regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    many = lambda first, n: F.array(*[worded.pick(DOMAINS, F.col(first) + i) for i in range(n)])
    rows = read_table(spark, d, "orders").select(
        worded.pick(VERDICTS, F.col("o_orderkey")).alias("expected_verdict"), worded.pick(VERDICTS, F.col("o_custkey")).alias("predicted_verdict"), many("o_orderkey", 2).alias("expected_domains"), many("o_custkey", 4).alias("predicted_domains")
    )
    return evidence.thresholds_pass(evidence.regression_metrics(rows), 0.4, 0.4, 0.4)


@query(f"""
WITH {EVIDENCE} SELECT CASE WHEN trust >= 0.9 THEN 'A+' WHEN trust >= 0.8 THEN 'A' WHEN trust >= 0.7 THEN 'B' WHEN trust >= 0.6 THEN 'C' WHEN trust >= 0.5 THEN 'D' ELSE 'F' END AS grade, count(*) AS n
FROM (SELECT round(trust, 6) AS trust FROM t) GROUP BY 1
""")
def a26_grade_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _trusted(spark, d).groupBy(scoring.grade(_r(F.col("trust"))).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_orderkey, round(least(1, pow(0.5, floor((epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 86400) / 365.0)), 6) AS recency FROM orders")
def dt1_recency_decay(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderkey", _r(scoring.recency_decay(F.col("o_orderdate"), F.lit(NOW).cast("timestamp_ntz"))).alias("recency"))


# the log

def _logs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("level"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(50))).alias("module"), "ts", "value")


LOGS = "g AS (SELECT event_id AS id, event_type AS level, 'm' || (user_id % 50) AS module, ts, value FROM events)"


@query(f"WITH {LOGS} SELECT id, level, module, ts FROM g WHERE level = 'click' ORDER BY ts DESC, id LIMIT 100 OFFSET 5")
def s7_log_query(spark: SparkSession, d: str) -> DataFrame:
    return logs.query(_logs(spark, d), level="click", limit=100, offset=5).select("id", "level", "module", "ts")


@query(f"WITH {LOGS} SELECT count(*) AS total, count(*) FILTER (level = 'click') AS n_click, count(*) FILTER (level = 'view') AS n_view FROM g")
def a1_level_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.level_counts(_logs(spark, d), ["click", "view"])


@query(f"WITH {LOGS} SELECT module, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, module LIMIT 20")
def a2_top_modules(spark: SparkSession, d: str) -> DataFrame:
    return logs.top_modules(_logs(spark, d))


@query(f"WITH {LOGS} SELECT id, ts FROM g WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 168 HOUR")
def k13_retention(spark: SparkSession, d: str) -> DataFrame:
    return logs.retained(_logs(spark, d), "2024-01-20 00:00:00").select("id", "ts")


from plumbline.plans import claims  # noqa: E402, F401  its queries register themselves
from plumbline.plans import ranking  # noqa: E402, F401
from plumbline.plans import policy  # noqa: E402, F401
from plumbline.plans import covering  # noqa: E402, F401
from plumbline.plans import searching  # noqa: E402, F401
from plumbline.plans import extracting  # noqa: E402, F401
from plumbline.plans import assorted  # noqa: E402, F401
from plumbline.plans import remaining  # noqa: E402, F401
from plumbline.plans import answering  # noqa: E402, F401
from plumbline.plans import naming  # noqa: E402, F401
from plumbline.plans import reading  # noqa: E402, F401
from plumbline.plans import rewriting  # noqa: E402, F401
from plumbline.plans import designing  # noqa: E402, F401
from plumbline.plans import learned  # noqa: E402, F401
