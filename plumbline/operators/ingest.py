"""Upserts: graph relations, their sources, and facts, as one aggregate over old and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import entity_id

#: Patterns of relation names and the name they stand for; the first that fits decides.
RELATIONS = (
    (r"\b(support|supports|supports the|contributes to)\b", "supports"),
    (r"\b(associated with|association with|linked to|correlates with)\b", "associated_with"),
    (r"\b(causes?|caused by|results? in|leads? to|induces?)\b", "causes"),
    (r"\b(reduces?|decreases?|lowers?)\b", "reduces"),
    (r"\b(increases?|raises?)\b", "increases"),
    (r"\b(prevents?|protects?)\b", "prevents"),
)
#: What marks a relation as causal, and a statement as one that denies a relation.
CAUSAL = ("cause", "contribut", "associat", "link", "increase risk", "lead to", "result in")
NEGATION = (
    r"\b(?:do|does|did|is|are|was|were|can|could|may|might|must|should|would|will)\s+not\b",
    r"\bno\s+(?:evidence|link|association|causal link)\b",
    r"\bnot\s+(?:associated|linked|causal)\b",
    r"\bunrelated to\b",
    r"\b(?:myth|debunked|false claim|no link)\b",
)


def relation_label(relation: Column) -> Column:
    """Lower case, spaces for underscores, and the standing name where a pattern fits."""
    bare = F.regexp_replace(F.trim(F.lower(F.replace(F.coalesce(relation, F.lit("")), F.lit("_"), F.lit(" ")))), r"\s+", " ")
    out = F.when(bare == "", "")
    for pattern, name in RELATIONS:
        out = out.when(bare.rlike(pattern), name)
    return out.otherwise(bare)


def relation_type(label: Column) -> Column:
    return F.when(label.isin("causes", "reduces", "increases", "prevents", "supports"), "causal_or_effect").when(label == "associated_with", "associative").otherwise("other")


def triple_statement(subject: Column, relation: Column, obj: Column) -> Column:
    """One sentence with single spaces and one full stop."""
    words = F.concat_ws(" ", subject, F.replace(relation, F.lit("_"), F.lit(" ")), obj)
    return F.concat(F.trim(F.regexp_replace(F.rtrim(words, F.lit(".")), r"\s+", " ")), F.lit("."))


def _blank(x: str) -> Column:
    return F.trim(F.coalesce(F.col(x), F.lit(""))) == ""


def unusable_triple(as_written: bool = True) -> Column:
    """Blank parts, no stance, or a causal relation drawn from a statement that denies it.

    The relation is read with spaces for underscores. Relations that deny by
    themselves are meant to pass (``does_not_``, ``not_``), but these marks are
    looked for when the underscores are gone, so that none does; with
    ``as_written`` off they do pass.
    """
    rel = F.trim(F.regexp_replace(F.lower(F.trim(F.replace(F.coalesce("relation", F.lit("")), F.lit("_"), F.lit(" ")))), r"\s+", " "))
    causal = F.lit(False)
    for mark in CAUSAL:
        causal = causal | rel.contains(mark)
    denies = rel.startswith("does_not_") | rel.startswith("not_") if as_written else rel.startswith("does not ") | rel.startswith("not ")
    negated = F.lit(False)
    for pattern in NEGATION:
        negated = negated | F.lower(F.coalesce(F.col("statement"), F.lit(""))).rlike(pattern)
    stance = F.coalesce(F.upper(F.trim("stance")), F.lit(""))
    return _blank("subject") | _blank("relation") | _blank("object") | ~stance.isin("SUPPORTS", "REFUTES") | (~denies & causal & negated)


def relations(triples: DataFrame) -> DataFrame:
    """Usable triples with the ids of their ends and of the relation."""
    t = triples.filter(~unusable_triple()).withColumns({"subject_id": entity_id(F.col("subject")), "object_id": entity_id(F.col("object"))})
    return t.withColumn("rid", F.concat_ws("|", "subject_id", "relation", "object_id"))


def ingest_counts(triples: DataFrame) -> DataFrame:
    """attempted, succeeded and failed, which is all that is not usable, in one pass."""
    return triples.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(~unusable_triple()).alias("succeeded"), F.count_if(unusable_triple()).alias("failed"))


def merge_relations(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """One row per rid: the highest confidence, and the last polarity that is not blank.

    Both have rid, confidence, stance and seq; old rows come before new ones.
    Union and aggregate take one shuffle with map-side folding, where an outer join would sort both sides.
    """
    cols = ["rid", "confidence", "stance", "seq"]
    rows = new.select(*cols, F.lit(1).alias("age"))
    if old is not None:
        rows = old.select(*cols, F.lit(0).alias("age")).unionByName(rows)
    filled = F.trim(F.coalesce(F.col("stance"), F.lit(""))) != ""
    last = F.max(F.when(filled, F.struct("age", "seq", "stance")))
    return rows.groupBy("rid").agg(F.max("confidence").alias("confidence"), last.getField("stance").alias("polarity"))


def relation_sources(triples: DataFrame) -> DataFrame:
    return triples.filter("source_url <> ''").select("rid", "source_url").distinct()


def upsert(old: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the newest of each key (largest ``order``, new before old); blank keys are left out."""
    rows = new.withColumn("_age", F.lit(1))
    if old is not None:
        rows = old.withColumn("_age", F.lit(0)).unionByName(rows)
    row = F.struct(*[F.col(c) for c in new.columns])
    kept = rows.filter(~_blank(key)).groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct("_age", order)).alias("_row"))
    return kept.select("_row.*")


def channels(logs: DataFrame) -> DataFrame:
    """One row per log row and channel: all, its request, its level."""
    names = F.array(F.lit("logs:all"), F.concat(F.lit("logs:request:"), "request_id"), F.concat(F.lit("logs:level:"), "level"))
    return logs.withColumn("channel", F.explode(F.array_compact(names)))
