"""Hard-negative mining: exact integer scores, behind a bound from an orthogonal PCA rotation.

Vectors are scaled and floored to integers. The eigenvectors of their second
moments rotate them, so that the first components carry most of every inner
product. A task adds up the leading components of an anchor and a row; the rest
is at most the product of the two residual norms, and a little slack covers the
rounding of the rotation. Pairs whose bound cannot reach what is asked are
discarded, after a quarter of the components or after half; the others are
scored as whole numbers, from the unrotated components.

Anchors go to the tasks in blocks of a fixed size: each block passes twice over
all rows, for the positives and then for the negatives within their range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tokens import tidy
from plumbline.session import cut, remove_folder, scratch_folder

#: Anchors of a block, which is broadcast: 8 * dims bytes each, 2 MB with 64 dimensions.
ANCHORS = 4096
#: Anchors that a task compares with a batch of rows at once, and pairs that are scored at once.
AT_ONCE, PAIRS = 256, 1 << 16
#: Integer components stay below this, so that no sum over 2**14 of them leaves 64 bits.
LIMIT = 1 << 24
#: Relative slack for the rounding of rotated products, far above 2**-52 * dims.
SLACK = 1e-9


def finite(vector: Column) -> Column:
    """Whether an array is there and all its components are numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def dense(column: pa.ListArray, dims: int) -> np.ndarray:
    """The arrays of a column as rows of doubles; shorter ones are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def whole_numbers(matrix: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * matrix), -LIMIT, LIMIT).astype(np.int64)


def _moments(dims: int, scale: int):
    """mapInArrow function: the second moments of a task's vectors, each taken at unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            q = whole_numbers(dense(batch.column(0), dims), scale).astype(np.float64)
            q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1)
            total += q.T @ q
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["at", "x"])

    return run


def rotation(rows: DataFrame, vec_col: str, dims: int, scale: int) -> np.ndarray:
    """Orthogonal columns, those with the largest second moments over all rows first; dims * dims numbers reach the driver."""
    sums = rows.select(vec_col).mapInArrow(_moments(dims, scale), "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toPandas().sort_values("at")
    if not len(sums):
        return np.eye(dims)
    return np.linalg.eigh(sums["x"].to_numpy().reshape(dims, dims))[1][:, ::-1]


class Rotated:
    """Integer vectors and the pieces that bounds need: leading components and residual norms after each stage."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray):
        self.whole = whole
        x = whole.astype(np.float64) @ turn
        dims = x.shape[1]
        self.norm = np.linalg.norm(x, axis=1)
        first, second = max(1, dims // 4), max(1, dims // 2)
        self.lead, self.rest = x[:, :first], np.linalg.norm(x[:, first:], axis=1)
        self.next, self.last = x[:, first:second], np.linalg.norm(x[:, second:], axis=1)


def survivors(a: Rotated, x: Rotated, allowed: np.ndarray, least: np.ndarray, most: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of allowed pairs whose score lies in least[i] .. most[i], as far as the bounds tell; scores are exact."""
    part = a.lead @ x.lead.T
    room = np.outer(a.rest, x.rest) + SLACK * np.outer(a.norm, x.norm) + 1e-6
    keep = allowed & (part + room >= least[:, None])
    if most is not None:
        keep &= part - room <= most[:, None]
    i, j = np.nonzero(keep)
    out = []
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        more = part[p, q] + np.einsum("ij,ij->i", a.next[p], x.next[q])
        room2 = a.last[p] * x.last[q] + SLACK * a.norm[p] * x.norm[q] + 1e-6
        fits = more + room2 >= least[p]
        if most is not None:
            fits &= more - room2 <= most[p]
        p, q = p[fits], q[fits]
        out.append((p, q, np.einsum("ij,ij->i", a.whole[p], x.whole[q])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (i, j, np.zeros(0, np.int64))


class Best:
    """The k best (score, id) of each key, smaller ids first among equal scores."""

    def __init__(self, keys: int, k: int):
        self.k, self.found = k, tuple(np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(keys, -np.inf)

    def add(self, key: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        if not len(key):
            return
        key, score, name = (np.concatenate(c) for c in zip(self.found, (key, score, name), strict=True))
        order = np.lexsort((name, -score, key))
        key, score, name = key[order], score[order], name[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        self.found = tuple(c[place < self.k] for c in (key, score, name))
        full = place == self.k - 1
        self.least[key[full]] = score[full]


def _parts(n: int) -> list[slice]:
    return [slice(at, min(n, at + AT_ONCE)) for at in range(0, n, AT_ONCE)]


def _take(a: Rotated, at: slice) -> Rotated:
    out = Rotated.__new__(Rotated)
    for name, value in vars(a).items():
        setattr(out, name, value[at])
    return out


def _positives(shared, k: int):
    """mapInArrow function: a task's k best rows of the same label and another id, for each anchor of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, whole, turn, scale = shared.value[:5]
        anchors = Rotated(whole, turn)
        best = [Best(part.stop - part.start, k) for part in _parts(len(ids))]
        for batch in batches:
            name, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = Rotated(whole_numbers(dense(batch.column(2), whole.shape[1]), scale), turn)
            for top, part in zip(best, _parts(len(ids)), strict=True):
                allowed = (labels[part, None] == label) & (ids[part, None] != name)
                i, j, score = survivors(_take(anchors, part), rows, allowed, top.least, None)
                top.add(i, score, name[j])
        for top, part in zip(best, _parts(len(ids)), strict=True):
            key, score, name = top.found
            yield pa.RecordBatch.from_arrays([pa.array((key + part.start).astype(np.int32)), pa.array(name), pa.array(score)], names=["a", "id", "score"])

    return run


def _negatives(shared, k: int):
    """mapInArrow function: a task's k best rows of other labels in the range below each positive's score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, whole, turn, scale, pos_id, low, high = shared.value
        anchors = Rotated(whole, turn)
        m = pos_id.shape[1]
        best = [Best((part.stop - part.start) * m, k) for part in _parts(len(ids))]
        for batch in batches:
            name, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows = Rotated(whole_numbers(dense(batch.column(2), whole.shape[1]), scale), turn)
            for top, part in zip(best, _parts(len(ids)), strict=True):
                # what a positive's list still takes: within its range, and not below the last of a full list
                least = np.maximum(low[part], top.least.reshape(-1, m)).min(axis=1)
                i, j, score = survivors(_take(anchors, part), rows, labels[part, None] != label, least, high[part].max(axis=1))
                for p in range(m):
                    fits = (score >= low[part][i, p]) & (score <= high[part][i, p])
                    top.add(i[fits] * m + p, score[fits], name[j[fits]])
        for top, part in zip(best, _parts(len(ids)), strict=True):
            key, score, name = top.found
            a, p = key // m + part.start, key % m
            columns = [pa.array(a.astype(np.int32)), pa.array(ids[a]), pa.array(pos_id[a, p]), pa.array(high[a, p].astype(np.int64)), pa.array(name), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


_FOUND = "a int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _block(spark, rows: DataFrame, anchors: pd.DataFrame, turn: np.ndarray, scale: int, k_pos: int, k_neg: int, low_pct: int) -> DataFrame | None:
    """The negatives of a block of anchors: a row for each, with its place in the block as ``a``."""
    dims = turn.shape[0]
    ids, labels = anchors["id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64)
    whole = whole_numbers(dense(pa.array(anchors["v"].tolist(), pa.list_(pa.float64())), dims), scale)
    shared = spark.sparkContext.broadcast((ids, labels, whole, turn, scale))
    found = rows.mapInArrow(tidy(_positives(shared, k_pos)), "a int, id long, score long")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id"))
    # at most k_pos rows for each anchor of the block
    best = found.withColumn("p", place).filter(F.col("p") <= k_pos).toPandas()
    shared.unpersist()
    if not len(best):
        return None
    pos_id = np.zeros((len(ids), k_pos), np.int64)
    low, high = np.full((len(ids), k_pos), np.inf), np.full((len(ids), k_pos), -np.inf)
    at = best["a"].to_numpy(), best["p"].to_numpy() - 1
    score = best["score"].to_numpy(np.int64)
    pos_id[at], high[at], low[at] = best["id"].to_numpy(), score, -(-low_pct * score // 100)
    shared = spark.sparkContext.broadcast((ids, labels, whole, turn, scale, pos_id, low, high))
    found = rows.mapInArrow(tidy(_negatives(shared, k_neg)), _FOUND)
    place = F.row_number().over(Window.partitionBy("a", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k_neg)


def hard_negatives(vectors: DataFrame, is_anchor: Column | str, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, low_pct: int = 80, anchors_at_once: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A score is the inner product of two vectors whose components x are
    floor(scale * x). An anchor's positives are its first ``positives`` rows of
    the same label and another id; for each the first ``negatives`` rows of
    another label with low_pct * positive_score <= 100 * negative_score <= 100
    * positive_score are returned. Higher scores come first, then smaller ids.

    Rows with a null id or label, a null vector, or a null or non-finite
    component take no part. Shorter vectors count as filled up with zeros, and
    components beyond LIMIT as LIMIT. Rows that share an id are rows of their
    own, none a positive of another; anchors alike in id, label and vector are
    worked out once and returned as often as they occur. Anchors without
    positives, and positives without negatives in their range, give no rows;
    nor does an empty table. Other columns are ignored.

    Every anchor meets every row in blocks, a fixed number of anchors at a time
    (``anchors_at_once``): a block and its positives pass through the driver and
    are broadcast, rows stay where they are. A task holds ``positives *
    negatives`` numbers an anchor of the block; no pair is written that is not
    among a task's best. Blocks are appended to a folder as they are done.
    """
    spark = vectors.sparkSession
    chosen = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite(F.col(vec_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"), F.coalesce(chosen, F.lit(False)).alias("asks"))
    anchors = cut(rows.filter("asks").groupBy("id", "label", "v").agg(F.count(F.lit(1)).alias("copies")))
    rows = rows.drop("asks")
    known = rows.agg(F.max(F.size("v")).alias("d")).first()["d"]
    turn = rotation(rows, "v", known or 1, scale)
    folder, wrote = scratch_folder(spark, "negatives"), False
    blocks = max(1, -(-anchors.count() // anchors_at_once))
    for b in range(blocks):
        block = anchors.filter(F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)) == b).toPandas()
        found = _block(spark, rows, block, turn, scale, positives, negatives, low_pct) if len(block) else None
        if found is None:
            continue
        copies = spark.createDataFrame(pd.DataFrame({"a": np.arange(len(block), dtype=np.int32), "copies": block["copies"].to_numpy()}), "a int, copies long")
        found.join(F.broadcast(copies), "a").write.mode("append").parquet(folder)  # one row for each anchor of the block
        wrote = True
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not wrote:
        return spark.createDataFrame([], schema)
    each = spark.read.parquet(folder).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    out = cut(each.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    remove_folder(spark, folder)
    return out
