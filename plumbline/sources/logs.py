"""The log store: append, filtered reads, statistics, retention; and what a stream appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query(logs: DataFrame, level: str | None = None, module: str | None = None, start: str | None = None, end: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, ties by id; only conditions that are given filter, and they reach the scan."""
    conditions: list[Column] = []
    if level is not None:
        conditions.append(F.col("level") == level)
    if module is not None:
        conditions.append(F.col("module") == module)
    if start is not None:
        conditions.append(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        conditions.append(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    for c in conditions:
        logs = logs.filter(c)
    return logs.orderBy(F.desc("ts"), "id").offset(offset).limit(limit)


def level_counts(logs: DataFrame, levels: list[str]) -> DataFrame:
    """One row: total, and a column per level."""
    return logs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("level") == x).alias(f"n_{x}") for x in levels])


def top_modules(logs: DataFrame, k: int = 20) -> DataFrame:
    return logs.groupBy("module").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module").limit(k)


def retained(logs: DataFrame, now: str, hours: int = 168) -> DataFrame:
    """Rows that retention keeps."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return logs.filter(F.col("ts") >= cutoff)


def iso_range(logs: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose ISO time, a text, lies between two others as texts: '2024-01-09' comes before '2024-01-09T00'."""
    for bound, keep in ((start, lambda c, x: c >= x), (end, lambda c, x: c <= x)):
        if bound is not None:
            logs = logs.filter(keep(F.col(column), F.lit(bound)))
    return logs


def append(logs: DataFrame, path: str) -> None:
    logs.write.mode("append").partitionBy("level").parquet(path)


def with_context(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns packed as JSON into ``context``, as a store of texts holds them; nulls are left out."""
    return rows.withColumn("context", F.to_json(F.struct(*columns))).drop(*columns)


def from_context(rows: DataFrame, schema: str) -> DataFrame:
    """``context`` unpacked by a schema; what is no JSON, and fields that it lacks, are null."""
    return rows.withColumn("_c", F.from_json("context", schema)).select(*rows.columns, "_c.*").drop("context")


def event_rows(events: DataFrame, module: str) -> DataFrame:
    """Log rows (level, message, module, request_id, context) of events on changed verdicts (fact_id, domain, ..)."""
    fields = F.to_json(F.struct(*events.columns))
    return events.select(
        F.lit("INFO").alias("level"), F.concat(F.lit("Verdict updated: "), F.coalesce("fact_id", F.lit(""))).alias("message"), F.lit(module).alias("module"),
        F.concat(F.lit("revalidation-"), F.coalesce("domain", F.lit(""))).alias("request_id"), fields.alias("context"),
    )
