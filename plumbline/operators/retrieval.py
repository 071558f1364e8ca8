"""Lexical and vector search for a set of stated queries against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import tokens

#: Query terms, and query vectors, up to which they go to every task (some tens of MB); beyond, they are joined or taken in turns.
BROADCAST_TERMS, BROADCAST_VECTORS = 500_000, 20_000


def in_topics(topic: Column, asked: Column) -> Column:
    """The topic is one of those asked for; asking for none takes all."""
    return (F.size(F.coalesce(asked, F.array().cast("array<string>"))) == 0) | F.array_contains(asked, topic)


def bm25_topk(docs: DataFrame, claims: DataFrame, id_col: str, text_col: str, claim_id: str, claim_text: str, k: int = 50, k1: float = 1.2, b: float = 0.75, pattern: str = r"[a-z]{2,}", topic_col: str | None = None, topics_col: str | None = None) -> DataFrame:
    """(claim, doc, bm25, rank): documents that hold all of a claim's terms, smallest (negated) score first.

    Documents become (term, tf) rows only for terms that some claim asks for. A
    claim's candidates are the documents that hold its two rarest terms; only
    these meet the claim's whole list of terms, as one row each. With
    ``topic_col`` and ``topics_col`` a claim takes documents of its topics only,
    which does not change document frequencies. Ties go to the smaller id.
    """
    c = F.col
    asks = claims.select(c(claim_id).alias("claim"), tokens(c(claim_text), pattern).alias("terms"), *([c(topics_col).alias("topics")] if topics_col else []))
    terms = asks.select("claim", F.explode("terms").alias("term"))
    asked = terms.select("term").distinct()
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
    every = docs.select(c(id_col).alias("doc"), F.regexp_extract_all(F.lower(F.coalesce(c(text_col), F.lit(""))), F.lit(pattern), F.lit(0)).alias("all"), *([c(topic_col).alias("topic")] if topic_col else []))
    size = every.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("all")).alias("mean"))
    found = every.select("doc", F.size("all").alias("dl"), F.explode("all").alias("term")).join(asked, "term")
    tf = found.groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # a term that no document holds leaves its claim without candidates
    ranked = terms.join(df, "term", "left").groupBy("claim").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))).alias("by_df"))
    rare = ranked.select("claim", F.get("by_df", F.lit(0))["term"].alias("t0"), F.get("by_df", F.lit(1))["term"].alias("t1"))
    held = tf.select("doc", "term")
    first = rare.join(held.withColumnRenamed("term", "t0"), "t0").select("claim", "t1", "doc")
    second = first.filter("t1 IS NOT NULL").join(held.withColumnRenamed("term", "t1"), ["t1", "doc"], "left_semi").select("claim", "doc")
    candidates = second.union(first.filter("t1 IS NULL").select("claim", "doc"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(size))  # one row
    idf = F.log(1 + (c("n") - c("df") + 0.5) / (c("df") + 0.5))
    part = idf * c("tf") * (k1 + 1) / (c("tf") + k1 * (1 - b + b * c("dl") / c("mean")))
    listed = scored.select("doc", "term", part.alias("part")).join(candidates.select("doc").distinct(), "doc").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "part"))).alias("parts"))
    hits = candidates.join(listed, "doc").join(asks, "claim")
    if topic_col and topics_col:
        hits = hits.join(every.select("doc", "topic"), "doc").filter(in_topics(c("topic"), c("topics")))
    values = F.transform("terms", lambda t: F.element_at("parts", t))
    hits = hits.withColumn("values", values).filter(~F.exists("values", lambda v: v.isNull()))
    hits = hits.select("claim", "doc", F.round(-F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 6).alias("bm25"))
    rank = F.row_number().over(Window.partitionBy("claim").orderBy("bm25", "doc"))
    return hits.withColumn("rank", rank).filter(c("rank") <= k)


def cosine_topk(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, least: float | None = None, tag_col: str | None = None, tags_col: str | None = None, same_col: str | None = None) -> DataFrame:
    """(query, neighbour, score, rank) by exact cosine; a vector is not its own neighbour; ties go to the smaller id.

    With ``tag_col`` of vectors and ``tags_col`` of queries a query takes only
    vectors whose tag is among its tags or is 'other'; no tags take all. With
    ``same_col`` the values of both must agree. ``least`` is the smallest score.
    The stated queries are sent to every task, BROADCAST_VECTORS at a time, and
    each task keeps its k best per query and batch, so a partition hands on at
    most k rows per query and batch, not one per pair.
    """
    c = F.col
    none = F.lit(None).cast("string")
    asked = queries.select(c(id_col).alias("q"), c(vec_col).alias("v"), (c(tags_col) if tags_col else F.lit(None)).cast("array<string>").alias("tags"), (c(same_col).cast("string") if same_col else none).alias("same"))
    rows = vectors.select(c(id_col).alias("id"), c(vec_col).alias("v"), (c(tag_col).cast("string") if tag_col else none).alias("tag"), (c(same_col).cast("string") if same_col else none).alias("same")).filter("v IS NOT NULL")
    turns = max(1, -(-asked.count() // BROADCAST_VECTORS))
    out = None
    for turn in range(turns):
        block = asked.filter(F.pmod(F.xxhash64("q"), F.lit(turns)) == turn).toPandas()
        matrix = _unit(np.array(block["v"].tolist(), dtype=np.float64)) if len(block) else np.zeros((0, 1))
        listed = [None if t is None or not len(t) else {*t, "other"} for t in block["tags"]]
        shared = vectors.sparkSession.sparkContext.broadcast((block["q"].to_numpy(), matrix, listed, block["same"].tolist()))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix, listed, same = shared.value
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                ids = batch.column(0).to_numpy()
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                scores = np.round(_unit(flat.reshape(len(ids), -1)[order]) @ matrix.T, 6)
                tags, own = np.array(batch.column(2).to_pylist(), dtype=object)[order], np.array(batch.column(3).to_pylist(), dtype=object)[order]
                allowed = {}
                found = []
                for j, q in enumerate(names):
                    mine = np.where(ids == q, -2.0, scores[:, j])
                    if listed[j] is not None or same[j] is not None:
                        key = (frozenset(listed[j] or ()), same[j])
                        if key not in allowed:
                            by_tag = np.ones(len(ids), bool) if listed[j] is None else np.array([t in listed[j] for t in tags])
                            allowed[key] = by_tag & (np.ones(len(ids), bool) if same[j] is None else own == same[j])
                        mine[~allowed[key]] = -2.0
                    if least is not None:
                        mine[mine < least] = -2.0
                    if len(mine) > 4 * k:
                        # whatever ties with the k-th best stays in play
                        near = np.flatnonzero(mine >= np.partition(mine, -k)[-k])
                    else:
                        near = np.arange(len(mine))
                    top = near[np.argsort(-mine[near], kind="stable")][:k]
                    top = top[mine[top] > -2]
                    found.append((np.full(len(top), q), ids[top], mine[top]))
                columns = [np.concatenate(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query", "neighbour", "score"])

        part = rows.mapInArrow(best, "query long, neighbour long, score double")
        out = part if out is None else out.union(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k)


def cosine_topk_with_retry(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, tags_col: str, **options) -> DataFrame:
    """cosine_topk(), and for queries that find nothing under their tags once more without them."""
    found = cosine_topk(vectors, queries, id_col, vec_col, tags_col=tags_col, **options)
    missed = queries.join(found.select(F.col("query").alias(id_col)).distinct(), id_col, "left_anti")
    options.pop("tag_col", None)
    return found.unionByName(cosine_topk(vectors, missed, id_col, vec_col, **options))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def by_ids(vectors: DataFrame, ids: DataFrame, id_col: str, vec_col: str | None = None, text_col: str | None = None) -> DataFrame:
    """The stored rows that ``ids`` (``id_col``) name, each once; an id that is not stored gives none.

    ``vec_col`` is left out unless it is named, so that a columnar scan never reads
    it; with ``text_col`` rows without text are left out.
    """
    kept = vectors if vec_col is not None else vectors.select(*[f.name for f in vectors.schema if f.dataType.simpleString() not in ("array<float>", "array<double>")])
    rows = kept.join(ids.select(id_col).distinct(), id_col, "left_semi")
    return rows.filter(F.coalesce(text_col, F.lit("")) != "") if text_col else rows
