"""Sums over all rows that come before, in an order over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut


def with_running_sum(df: DataFrame, order: list[str], value: Column | str, name: str, parts: int | None = None) -> DataFrame:
    """df with ``name``: the sum of ``value`` over all rows before, in ``order`` (nulls first, ties in any order).

    Rows are dealt by ranges and written once; one sum per range reaches the
    driver. The sums depend on the rows and their order alone, as long as no
    rows are alike in ``order``.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in order]
    dealt = df.withColumn("_value", value if isinstance(value, Column) else F.col(value))
    # sampling for the ranges must not work out the rows twice
    dealt = cut(dealt)
    dealt = dealt.repartitionByRange(parts, *keys) if parts else dealt.repartitionByRange(*keys)
    ranged = cut(dealt.withColumn("_part", F.spark_partition_id()))
    begin, before = [], 0
    for part, s in sorted((r["_part"], r["s"]) for r in ranged.groupBy("_part").agg(F.sum("_value").alias("s")).collect()):
        begin.append((part, before))
        before += s or 0
    known = spark.createDataFrame(begin, "_part int, _begin long")  # one row per range
    run = F.coalesce(F.sum("_value").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn(name, run).join(F.broadcast(known), "_part").withColumn(name, F.col(name) + F.col("_begin")).drop("_part", "_begin", "_value")
