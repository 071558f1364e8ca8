"""Queries over the real texts of the tables: pages, documents, benchmark passages and conversations, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import content, entities, pages
from plumbline.plans.designing import SLOTS, _asked
from plumbline.plans.naming import PHRASE, SALIENT, TOK, UNIQUE
from plumbline.plans.registry import query
from plumbline.plans import worded
from plumbline.plans.worded import s_ascii, sql_pick, sql_text
from plumbline.session import read_table

c = F.col


@query()
def ul16_main_content(spark: SparkSession, d: str) -> DataFrame:
    return content.scraped(read_table(spark, d, "pages")).select("page_id", "source", "published_at", "content")


FIRM = lambda xs: f"list_filter(list_transform({xs}, lambda p: {PHRASE('p')}), lambda e: e <> '' AND len({TOK('e')}) > 0 AND {SALIENT('e')} AND NOT list_has_any({TOK('e')}, {sql_text(entities.SPOILED)}) AND NOT (len({TOK('e')}) > 1 AND list_contains({sql_text(entities.LEADING)}, {TOK('e')}[1])))"
TELLING = lambda x: f"list_filter({TOK(x)}, lambda t: NOT list_contains({sql_text(entities.FALLBACK_STOP)}, t))"


@query(f"""
WITH {SLOTS[: SLOTS.index('s1 AS')].rstrip().rstrip(',')}, f1 AS (SELECT id, {s_ascii("coalesce(claim0, '')")} AS m FROM s0),
f2 AS (SELECT id, {TELLING('m')} AS one, list_filter(list_transform(regexp_extract_all(m, {sql_text(entities.CHUNK)}, 1), lambda p: {TELLING('p')}), lambda t: len(t) >= 2) AS runs FROM f1),
f3 AS (SELECT id, {FIRM('one')} || {FIRM("list_transform(runs, lambda t: array_to_string(t, ' '))")} AS every FROM f2)
SELECT id AS claim_id, array_to_string({UNIQUE('every')}[1:10], '|') AS entities FROM f3
""")
def u78_fallback_entities(spark: SparkSession, d: str) -> DataFrame:
    return _asked(spark, d).select("claim_id", F.array_join(entities.fallback_entities(c("claim")), "|").alias("entities"))


#: Addresses, and whether a browser is of no use once they are forbidden.
FORBIDDEN = (("https://stacks.cdc.gov/view/1.pdf", True), ("https://www.Stacks.CDC.gov/x.PDF?y=1", True), ("https://stacks.cdc.gov/view/1", False), ("https://cdc.gov/a.pdf", False), (None, False), ("", False), ("stacks.cdc.gov/a.pdf", False))
PLACE, OFF = zip(*FORBIDDEN, strict=True)


@query(f"SELECT o_orderkey AS id, ([{', '.join(str(x).lower() for x in OFF)}])[o_orderkey % {len(OFF)} + 1] AND [403, 404, 200, NULL][o_custkey % 4 + 1] IS NOT DISTINCT FROM 403 AS no_browser FROM orders")
def f55_forbidden_pdfs(spark: SparkSession, d: str) -> DataFrame:
    status = F.get(F.array(F.lit(403), F.lit(404), F.lit(200), F.lit(None)), F.pmod("o_custkey", F.lit(4)).cast("int"))
    return read_table(spark, d, "orders").select(c("o_orderkey").alias("id"), pages.needs_no_browser(worded.pick(PLACE, c("o_orderkey")), status).alias("no_browser"))
