"""Operators on arrays and on rows in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunks(items: Column, size: int) -> Column:
    """Pieces of ``size`` items, the last one shorter; a size below 1 is an error."""
    if size < 1:
        raise ValueError("size must be positive")
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(size)))
    return F.coalesce(F.transform(starts, lambda i: F.slice(items, i, size)), F.array().cast("array<array<string>>"))


def ngrams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1))
    return F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")), F.array().cast("array<string>"))


def phrase_present(tokens: Column, phrase: Column) -> Column:
    """All but one of the phrase's distinct tokens are there, and one at least."""
    return (F.size(phrase) > 0) & (F.size(F.array_intersect(tokens, phrase)) >= F.greatest(F.lit(1), F.size(F.array_distinct(phrase)) - 1))


def merge_candidates(rows: DataFrame, key: str, seq: str, score: str, source: str) -> DataFrame:
    """Rows alike in lower-cased ``key``: their distinct sources, and scores folded by halving in the order of ``seq``.

    Folding x by (x + y) / 2 weighs the i-th of n scores by 2^(i-n-1), the first
    by 2^(1-n), so it is a plain sum after numbering.
    """
    keyed = rows.select(F.lower(F.trim(F.coalesce(F.col(key), F.lit("")))).alias("key"), F.col(seq).alias("seq"), F.col(score).alias("score"), F.col(source).alias("source"))
    group = Window.partitionBy("key")
    numbered = keyed.withColumns({"i": F.count("score").over(group.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)), "n": F.count("score").over(group)})
    power = F.when(F.col("i") == 1, 1 - F.col("n")).otherwise(F.col("i") - F.col("n") - 1)
    return numbered.groupBy("key").agg(F.min("seq").alias("seq"), F.countDistinct("source").alias("sources"), F.sum(F.col("score") * F.pow(F.lit(2.0), power)).alias("score"))


def until_enough(rows: DataFrame, group: str, order: list[str], item: str, enough: int) -> DataFrame:
    """Rows in order (of equal rows those with a new item first) up to the one with which ``enough`` distinct items of the group are reached."""
    first = F.row_number().over(Window.partitionBy(group, item).orderBy(*order)) == 1
    before = Window.partitionBy(group).orderBy(*order, F.desc("_first")).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.col("_first").cast("long")).over(before), F.lit(0))
    return rows.withColumn("_first", first).withColumn("_seen", seen).filter(F.col("_seen") < enough).drop("_first", "_seen")


def change(rows: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """value less that of the row before; null for a group's first."""
    return rows.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(*order)))


def fetch_statistics(attempts: DataFrame) -> DataFrame:
    """(domain, method, success, latency) to success rate and mean latency per domain and method, with totals of each."""
    agg = attempts.groupingSets([["domain", "method"], ["domain"], ["method"]], "domain", "method")
    return agg.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("double")).alias("success_rate"), F.avg("latency").alias("latency"))


def selected_results(rows: DataFrame, group: str, order: str, url: str) -> DataFrame:
    """Search results (gate: search.quality_gate) by score, then address: 3 of a group if two of its first three pass, 5 if one does, else 8.

    Only the first eight in ``order`` are looked at.
    """
    own = Window.partitionBy(group)
    placed = rows.withColumn("_place", F.row_number().over(own.orderBy(order)))
    good = F.count_if((F.col("_place") <= 3) & F.col("gate.passed")).over(own)
    placed = placed.withColumn("_top", F.when(good >= 2, 3).when(good == 1, 5).otherwise(8)).filter("_place <= 8")
    rank = F.row_number().over(own.orderBy(F.col("gate.score").desc(), F.coalesce(url, F.lit("")), order))
    return placed.withColumn("rank", rank).filter("rank <= _top").drop("_place", "_top")


def by_index(results: DataFrame, items: DataFrame, group: str, order: str, every_item: bool = False) -> DataFrame:
    """Results that name their items by ``index``, from 0 in the ``order`` of a group, with the items; an index out of range is dropped.

    With ``every_item`` items without a result stay, with nulls.
    """
    numbered = items.withColumn("index", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
    return numbered.join(results, [group, "index"], "left" if every_item else "inner")
