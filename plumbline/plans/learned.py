"""Queries on search results that teach, and on the stored vector index, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import search
from plumbline.operators import vector_index
from plumbline.plans import worded
from plumbline.plans.registry import _sql, query
from plumbline.plans.worded import ENTITIES, sql_pick, sql_text
from plumbline.session import cut, read_table, remove_folder, scratch_folder
from plumbline.streaming import learning

c = F.col
#: Addresses of results, and whether they are trusted and worth reading.
PLACES = (
    ("https://www.cdc.gov/p/zinc", True), ("https://pubmed.ncbi.nlm.nih.gov/123", True), ("https://blog.example/zinc", False), ("https://www.cdc.gov/files/vitamin.pdf", True), ("https://www.who.int/policy/iron", True), ("", False),
    (None, False), ("https://www.cdc.gov/references", False), ("https://www.nhs.uk/sleep", True), ("https://www.who.int/a?utm_source=x", False),
)
TITLES = ("Zinc prevents the common cold", "A manual of vaccines", None, "Smoking and the risk of lung cancer", "Procurement template", "", "Coffee: myth or fact", "Handbook on iron and anemia", "Sleep")
MEMORY = 3 * 86400.0
URL, OKS = zip(*PLACES, strict=True)
KIND = sql_pick(search.PRIORITY, "o_orderkey")
TYPED = " OR ".join(f"(kind = '{n}' AND ({' OR '.join(f'contains(tx, {sql_text(k)})' for k in keys)}))" for n, keys in search.KEYWORDS.items())
DRIFT = "list_filter([CASE WHEN ends_with(lower(string_split(url, '?')[1]), '.pdf') OR list_contains(regexp_extract_all(lower(concat_ws(' ', url, coalesce(title, ''), '')), '\\b[a-z][a-z0-9\\-]{2,}\\b'), 'pdf') THEN 'pdf' END, " + ", ".join(f"CASE WHEN contains(lower(concat_ws(' ', url, coalesce(title, ''))), '{t}') THEN '{t}' END" for t in search.LOW_TEXTS) + "], lambda x: x IS NOT NULL)"
MARKS = learning.MARKS


@query(f"""
WITH o AS (SELECT o_orderkey AS id, {KIND} AS kind, {sql_pick(ENTITIES, 'o_custkey')} AS ents, epoch(o_orderdate)::DOUBLE AS at_ FROM orders),
r0 AS (SELECT l_orderkey AS id, {worded.SEQUENCE_SQL} AS seq, {sql_pick(URL, 'l_partkey + l_linenumber')} AS url, {sql_pick(TITLES, 'l_suppkey')} AS title, ([{', '.join(str(x).lower() for x in OKS)}])[(l_partkey + l_linenumber) % {len(OKS)} + 1] AS ok FROM lineitem),
r1 AS (SELECT *, row_number() OVER (PARTITION BY id, url ORDER BY seq) AS nth FROM r0 WHERE ok), r2 AS (SELECT r1.*, kind, ents, at_, row_number() OVER (PARTITION BY id ORDER BY seq) AS place, lower(concat_ws(' ', coalesce(title, ''), '', url)) AS tx FROM r1 JOIN o USING (id) WHERE nth = 1),
r3 AS (SELECT *, len(list_filter(coalesce(ents, []), lambda e: coalesce(e, '') <> '' AND contains(tx, lower(e)))) > 0 AS m, ({TYPED}) AS ty, {' OR '.join(f"contains(tx, '{x}')" for x in search.LOW_TEXTS)} AS lo, regexp_matches(lower(url), '\\.(?:pdf|docx?|pptx?)\\b') AS fi FROM r2),
r4 AS (SELECT *, 1.5 * m::INT + 1.0 * ty::INT + 0.75 - 1.0 * lo::INT - 0.5 * fi::INT AS score FROM r3), r5 AS (SELECT *, score >= 1.5 AND (m OR ty) AS passed FROM r4), r6 AS (SELECT *, count(*) FILTER (place <= 3 AND passed) OVER (PARTITION BY id) AS good FROM r5),
r7 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, url) AS rank FROM r6 WHERE place <= 8), s AS (SELECT id, string_agg(url, ' ' ORDER BY rank) AS selected FROM r7 WHERE rank <= CASE WHEN good >= 2 THEN 3 WHEN good = 1 THEN 5 ELSE 8 END GROUP BY 1),
l AS (SELECT id, list_distinct(flatten(list({DRIFT}))) AS marks FROM r5 WHERE NOT passed GROUP BY 1), q AS (SELECT o.*, coalesce(marks, []) AS marks FROM o LEFT JOIN l USING (id)),
t AS (SELECT kind, at_, {', '.join(f"bool_or(list_contains(marks, '{m}')) AS m{i}" for i, m in enumerate(MARKS))} FROM q GROUP BY ALL),
u AS (SELECT kind, at_, {', '.join(f"max(CASE WHEN m{i} THEN at_ END) OVER w AS t{i}" for i in range(len(MARKS)))} FROM t WINDOW w AS (PARTITION BY kind ORDER BY at_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT q.id AS query, q.kind AS claim_type, coalesce(selected, '') AS selected, array_to_string(list_sort(q.marks), ' ') AS learned, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN q.at_ - t{i} <= {MEMORY} THEN '{m}' END" for i, m in enumerate(MARKS))}], lambda x: x IS NOT NULL)), ' ') AS left_out
FROM q JOIN u ON q.kind = u.kind AND q.at_ = u.at_ LEFT JOIN s ON s.id = q.id
""")
def f34_f35_selected_and_learned(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").select(c("l_orderkey").alias("query"), worded.sequence().alias("seq"), worded.pick(URL, c("l_partkey") + c("l_linenumber")).alias("url"), worded.pick(TITLES, c("l_suppkey")).alias("title"), F.lit(None).cast("string").alias("snippet"))
    pages = learning.with_pages(lines).filter("page.usable")
    held = pages.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "page"))), lambda x: x["page"]).alias("pages"))
    asked = read_table(spark, d, "orders").select(c("o_orderkey").alias("query"), worded.pick(search.PRIORITY, c("o_orderkey")).alias("claim_type"), worded.pick(ENTITIES, c("o_custkey")).alias("anchors"), (F.unix_micros(c("o_orderdate").cast("timestamp")) / 1e6).alias("at"))
    done = learning.processed(asked.join(held, "query", "left")).select("query", "claim_type", "at", "selected", "learned")
    rows = learning.with_learned(done, MEMORY)
    return rows.select("query", "claim_type", *[F.array_join(x, " ").alias(x) for x in ("selected", "learned", "left_out")])


def _searched(spark: SparkSession, d: str, probes: int | None) -> DataFrame:
    vectors, path = read_table(spark, d, "embeddings"), scratch_folder(spark, "index")
    vector_index.build_index(vectors, path, "vec_id", "embedding")
    out = vector_index.search_index(spark, path, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, probes)
    out = cut(out)  # k rows a query are kept, the index is not
    remove_folder(spark, path)
    return out


@query()
def k19_index_search(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, None)


@query(_sql["s1_vector_topk"])
def k19_index_all_cells(spark: SparkSession, d: str) -> DataFrame:
    return _searched(spark, d, vector_index.MOST_CELLS)
