"""Exact dedup: group by a 128-bit content hash, then by the bytes themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """128 bits: the first half of the SHA-256 of the text's UTF-8 bytes."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by ``hash_of`` and, within one hash, by their bytes: the
    grouping key is (hash, text), so texts that only share a hash never meet.
    Equal texts fold inside each map task before anything is shuffled; a text
    crosses the network once per task that holds it. The way back to the rows
    is a join of narrow rows on the digests, whose hot keys AQE splits.

    ``keep`` is ``smallest`` or ``largest``: which id of a group stays.
    Null text counts as empty; empty texts are one group. Null ids count in the
    group's size and stay only if the group has no other id. Rows repeated with
    the id that stays are all marked kept. Other columns are ignored.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), hash_of(text).alias("_hash"))
    groups = rows.groupBy("_hash", "_text").agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("_hash", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    narrow = rows.select("_id", "_hash", F.sha2("_text", 256).alias("text_sha256"))
    return narrow.join(groups, ["_hash", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the rows of equal texts that do not stay; of wholly repeated rows one stays."""
    best = {"smallest": F.min_by, "largest": F.max_by}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [c for c in docs.columns if c != text_col]
    row = F.struct(F.col(text_col).isNull().alias("_null"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    # null ids order after all others, so that they lose
    rank = F.struct(F.col(id_col).isNull() if keep == "smallest" else F.col(id_col).isNotNull(), F.col(id_col))
    rows = docs.select(content_hash(text).alias("_hash"), text.alias("_text"), rank.alias("_rank"), row.alias("_row"))
    kept = rows.groupBy("_hash", "_text").agg(best("_row", "_rank").alias("_row"))
    value = {c: F.col("_row").getField(f"c{i}") for i, c in enumerate(names)}
    value[text_col] = F.when(~F.col("_row").getField("_null"), F.col("_text"))
    return kept.select(*[value[c].alias(c) for c in docs.columns])
