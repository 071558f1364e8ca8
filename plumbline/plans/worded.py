"""Claims and evidence in words, made from the driver's tables, for queries and their SQL alike.

The tables hold no sentences that claim anything, so an order stands for a claim
and takes one of CLAIMS by its key, and an order line stands for a row of
evidence and takes one of STATEMENTS. The SQL lists are written from the same
Python lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import read_table

NOW = "2001-06-01 00:00:00"
CLAIMS = (
    "Zinc supplements reduce the duration of the common cold",
    "Antibiotics do not work against viral infections",
    "Smoking causes lung cancer",
    "Vitamin D prevents fractures in older adults",
    "Many people believe that vaccines cause autism",
    "The receptor pathway lowers blood pressure",
    "Coffee is effective for alertness, and tea helps too",
    "More than 25 percent of adults sleep less than 7 hours",
    "",
    None,
    "Vaccines never cause autism",
    "You can tell a fatty liver by noticeable symptoms",
    "All people with anemia definitely need iron",
    "Exercise may improve mood if done daily",
    "An adult human has 206 bones",
    "How many cells does the liver have",
    "Vitamin C has proven benefits, and always cures a cold",
    "Garlic is linked to lower cholesterol",
    "Sugar increases the risk of diabetes",
)
ENTITIES = (
    ("zinc", "common cold"), ("Antibiotics", "viral infection"), ("smoking", "lung cancer"), ("vitamin d", "fracture"), ("vaccine", "autism"), ("receptor", "blood pressure"), ("coffee",),
    ("sleep",), (), None, ("vaccines", "autism", None), ("fatty liver", ""), ("anemia", "iron"), ("exercise", "mood"), ("bones",), ("liver", "cells"), ("vitamin c", "cold"), ("garlic", "cholesterol"), ("sugar", "diabetes"),
)
STATEMENTS = (
    "Zinc lozenges reduced the duration of the common cold in a randomized trial.",
    "Zinc supplements do not reduce colds.",
    "Antibiotics are not effective against viral infections such as the flu.",
    "Antibiotics work against bacteria, only for bacterial infections",
    "Smoking causes lung cancer and heart disease.",
    "There is no evidence that smoking prevents lung cancer.",
    "Vitamin D and calcium prevent fractures in older adults",
    "Vitamin A did not prevent fractures in a double-blind clinical trial of 1,200 participants.",
    "Vaccines do not cause autism.",
    "A survey found vaccine hesitancy; the autism link is a myth",
    "The receptor pathway lowers blood pressure in mice",
    "Please enable JavaScript and cookies to read on",
    "Coffee is effective for alertness",
    "Tea helps, but the evidence is inconclusive",
    "",
    "About 30 percent of adults sleep less than 7 hours a night",
    "Fatty liver is often asymptomatic and silent; patients have no symptoms at all",
    "Iron treats anemia, and too much iron damages the liver",
    "Exercise improves mood and reduces stress",
    "An adult human skeleton has 206 bones",
    "The liver has some 240 billion cells.",
    "Vitamin C does not cure a cold, systematic review and meta-analysis confirmed",
    "Garlic may lower cholesterol in rare cases, case report",
    "Sugar increases the risk of diabetes and obesity",
    "Sugar doesn't increase the risk of diabetes",
    "access denied: permission required",
    "Access to clean water is improving",
    "ANTIBIOTICS DO NOT WORK AGAINST VIRAL INFECTIONS",
    "Zinc Lozenges   reduced the duration of the common cold in a randomized trial.",
    "Researchers say it suggests possibly mixed evidence when taken daily",
)
URLS = (
    "https://www.cdc.gov/p", "https://pubmed.ncbi.nlm.nih.gov/1?utm_source=a&b=2&a=1", "https://www.Cochrane.org:443/review/", "http://news.example.com:80/a/", "https://blog.example/b?z=1&a=2&a=1#top",
    None, "", "none", "https://who.int/fact?x=", "https://sub.nhs.uk/zinc",
)


def pick(texts: tuple, index: Column) -> Column:
    """One of the texts, or of the lists of texts, by its place."""
    listed = [F.lit(None) if t is None else F.array(*[F.lit(x) for x in t]).cast("array<string>") if isinstance(t, tuple) else F.lit(t) for t in texts]
    return F.get(F.array(*listed), F.pmod(index, F.lit(len(texts))).cast("int"))


def sql_text(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, tuple | list):
        return "[" + ", ".join(sql_text(y) for y in x) + "]" + ("::VARCHAR[]" if not x else "")
    return "'" + str(x).replace("'", "''") + "'"


def sql_pick(texts: tuple, index: str) -> str:
    return f"({sql_text(texts)})[({index}) % {len(texts)} + 1]"


def claims(spark: SparkSession, d: str) -> DataFrame:
    """claim_id, claim, entities."""
    key = F.col("o_orderkey")
    return read_table(spark, d, "orders").select(key.alias("claim_id"), pick(CLAIMS, key).alias("claim"), pick(ENTITIES, key).alias("entities"))


def sequence() -> Column:
    """A number of an order line that no other line of its order has."""
    c = F.col
    return c("l_linenumber").cast("long") * 10000000000 + c("l_partkey") * 100000 + c("l_suppkey") * 100 + c("l_quantity").cast("long")


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as evidence in words: of the same claim, with ties, gaps, copies, and both kinds of source."""
    c = F.col
    pair = c("l_partkey") + 3 * c("l_orderkey")
    stance = F.when(c("l_returnflag") == "A", "entails").when(c("l_returnflag") == "R", "contradicts").otherwise("neutral")
    return read_table(spark, d, "lineitem").select(
        c("l_orderkey").alias("claim_id"), sequence().alias("seq"), pick(STATEMENTS, pair).alias("statement"), pick(URLS, c("l_suppkey")).alias("source_url"),
        F.when(c("l_linestatus") == "F", "kg").otherwise("sem").alias("side"), (c("l_discount") * 10).alias("score"), F.when(c("l_linenumber") % 5 != 0, c("l_shipdate")).alias("published_at"),
        F.when(c("l_partkey") % 3 == 0, c("l_tax") * 12).alias("credibility"), (c("l_quantity") < 10).alias("is_backfill"), pick(ENTITIES, c("l_partkey")).alias("entities"), stance.alias("stance"),
        (c("l_quantity") / 50).alias("weight"), c("l_quantity").alias("quantity"), (c("l_tax") * 12).alias("trust"), F.lit(None).cast("string").alias("candidate_type"),
    )


SEQUENCE_SQL = "(l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey * 100 + l_quantity::BIGINT)"
CLAIMS_SQL = f"c AS (SELECT o_orderkey AS claim_id, {sql_pick(CLAIMS, 'o_orderkey')} AS claim, {sql_pick(ENTITIES, 'o_orderkey')} AS entities FROM orders)"
EVIDENCE_SQL = f"""
ev AS (SELECT l_orderkey AS claim_id, {SEQUENCE_SQL} AS seq, {sql_pick(STATEMENTS, 'l_partkey + 3 * l_orderkey')} AS statement, {sql_pick(URLS, 'l_suppkey')} AS source_url,
    CASE l_linestatus WHEN 'F' THEN 'kg' ELSE 'sem' END AS side, l_discount * 10 AS score, CASE WHEN l_linenumber % 5 <> 0 THEN l_shipdate END AS published_at,
    CASE WHEN l_partkey % 3 = 0 THEN l_tax * 12 END AS credibility, l_quantity < 10 AS is_backfill, {sql_pick(ENTITIES, 'l_partkey')} AS entities,
    CASE l_returnflag WHEN 'A' THEN 'entails' WHEN 'R' THEN 'contradicts' ELSE 'neutral' END AS stance, l_quantity / 50 AS weight, l_quantity AS quantity, l_tax * 12 AS trust FROM lineitem)
"""

# SQL of the word functions; texts are ASCII here, so that both engines agree on letters


def s_low(x: str) -> str:
    return f"lower(coalesce({x}, ''))"


def s_has(x: str, pattern: str) -> str:
    return f"regexp_matches({s_low(x)}, {sql_text(pattern)})"


def s_any(x: str, phrases: tuple) -> str:
    return "(" + " OR ".join(f"contains({s_low(x)}, {sql_text(p)})" for p in phrases) + ")"


def s_hits(x: str, phrases: tuple) -> str:
    return "(" + " + ".join(f"contains(' ' || {s_low(x)} || ' ', {sql_text(f' {p} ')})::INT" for p in phrases) + ")"


def s_tokens(x: str, pattern: str, stop: tuple = (), longer_than: int = 0) -> str:
    """Distinct tokens in the order of their first places."""
    every = f"regexp_extract_all({x}, {sql_text(pattern)})"
    drop = f" AND NOT list_contains({sql_text(tuple(stop))}, w)" if stop else ""
    return f"list_filter({every}, lambda w, i: list_position({every}, w) = i AND length(w) > {longer_than}{drop})"


def s_set(x: str, pattern: str, stop: tuple = (), longer_than: int = 0) -> str:
    """Distinct tokens in any order."""
    drop = f"NOT list_contains({sql_text(tuple(stop))}, w) AND " if stop else ""
    return f"list_distinct(list_filter(regexp_extract_all({x}, {sql_text(pattern)}), lambda w: {drop}length(w) > {longer_than}))"


def s_shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def s_ascii(x: str) -> str:
    """Signs of other scripts as tildes, their letters as underscores: so word boundaries, which see ASCII alone, fall where they fall in Spark."""
    return f"regexp_replace(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}\\p{{M}}\\x00-\\x7F]', '~', 'g'), '[^\\x00-\\x7F]', '_', 'g')"
