"""One- and two-hop expansion over an edge table (subject, relation, object, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_hop(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an end among ``entities`` (name), each once.

    Two equi-joins and a union instead of one join on either end, which Spark
    could only do by comparing all rows.
    """
    names = entities.select(F.lower("name").alias("name")).distinct()
    e = edges.withColumn("s", F.lower("subject")).withColumn("o", F.lower("object"))
    left = e.join(names, e.s == names.name, "left_semi")
    right = e.join(names, e.o == names.name, "left_semi")
    return left.union(right).drop("s", "o").distinct()


def two_hop(edges: DataFrame, entities: DataFrame, penalty: float = 0.15) -> DataFrame:
    """Paths subject -> middle -> object whose subject is among ``entities``; score is the weaker edge less the hop penalty."""
    names = entities.select(F.lower("name").alias("name")).distinct()
    first = edges.join(names, F.lower(edges.subject) == names.name, "left_semi")
    first = first.select("subject", F.col("relation").alias("relation1"), F.col("object").alias("middle"), F.col("confidence").alias("c1"))
    second = edges.select(F.col("subject").alias("middle"), F.col("relation").alias("relation2"), "object", F.col("confidence").alias("c2"))
    paths = first.join(second, "middle").filter("subject <> object")
    score = F.round(F.greatest(F.lit(0.0), F.least("c1", "c2") - penalty), 6)
    return paths.select("subject", "relation1", "middle", "relation2", "object", score.alias("score")).distinct()
