"""MinHash near-dedup: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard.

Every document's shingle set is hashed once; its k smallest hashes are its
sketch. Documents with equal sets fold into one node first. Two sets with a
Jaccard similarity of at least t share at least ``need`` of their retained
values but for a chance of about 1e-8, so each node is listed under its
``s - need + 1`` rarest retained values only: any two nodes that share ``need``
values then meet in a list, while values of passages that very many documents
share are listed by hardly any of them.

Inside a list no pairs are made at large. Each node is checked against the
list's first node; verified links are contracted to components; lists whose
nodes all fell into one component are done, and the others go on with a first
node of another component. What pairs are left then are checked in full: in
short lists by a join, in long ones in blocks, where sketches alone decide what
goes on to the exact check.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.tokens import Words, mix, shingle_sets, text_chunks, tidy, tidy_group
from plumbline.session import cut, spare_name, written

#: Rows up to which a narrow table of 16-byte keys may be broadcast (about 64 MB in memory).
BROADCAST_ROWS = 500_000
#: Rows of a block of a long list, and the length up to which a list is short.
BLOCK, SHORT = 2048, 48
#: Retained values that blocks compare; sets up to this size are compared whole.
WIDE = 256
#: Rounds of checks against first nodes before the rest is checked in full.
ROUNDS = 2


def needed_share(threshold_pct: int, k: int | None) -> float:
    """The share of retained values that a true pair has in common: t less 6.5 standard deviations; t itself where all are retained."""
    t = threshold_pct / 100
    if k is None:
        return t
    return max(1 / k, t - 6.5 * math.sqrt(t * (1 - t) / k))


def _sets_of(shingle: int, k: int | None):
    """mapInArrow function: (rid, text) to rid, n, fp and the k smallest hashes (all: k is None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0)
            for part, texts in text_chunks(batch.column(1)):
                sets = shingle_sets(Words(texts), shingle)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                flat = np.concatenate([*sets, np.zeros(1, np.int64)]).astype(np.uint64)
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(flat[:-1] ^ np.uint64(salt)))]) for salt in (0x51ED270B7A1F39C5, 0xA24BAED4963EE407)]
                halves = [(s[at[1:]] - s[at[:-1]]).astype(">u8") for s in sums]
                raw = np.stack([h.view(np.uint8).reshape(-1, 8) for h in halves], axis=1).reshape(-1, 16) if len(n) else np.zeros((0, 16), np.uint8)
                held = np.minimum(n, k) if k else n
                values = np.concatenate([s[:h] for s, h in zip(sets, held, strict=True)]) if len(sets) else np.zeros(0, np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [key.slice(part.start, part.stop - part.start), pa.array(n), pa.array([r.tobytes() for r in raw], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(values))],
                    names=["rid", "n", "fp", "vals"],
                )

    return run


_SCHEMA = "rid {}, n long, fp binary, vals array<long>"


def shingle_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, k: int | None) -> DataFrame:
    """rid, n (set size), fp (128-bit fingerprint of the set) and vals (the k smallest hashes) of each row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text")).mapInArrow(tidy(_sets_of(shingle, k)), _SCHEMA.format(kind))


def _verified(pairs: DataFrame, sets: DataFrame, threshold_pct: int, k: int | None, share: float) -> DataFrame:
    """The pairs (a, b) of nodes that pass the union-sketch estimate (k is None: without it) and then the exact test."""
    left = sets.select(F.col("fp").alias("b"), F.col("vals").alias("vb"))
    right = sets.select(F.col("fp").alias("a"), F.col("vals").alias("va"))
    both = pairs.join(left, "b").join(right, "a")
    va, vb = F.col("va"), F.col("vb")
    fits = 100 * F.least(F.size(va), F.size(vb)) >= threshold_pct * F.greatest(F.size(va), F.size(vb))
    likely = F.lit(True)
    if k is not None:
        low = F.slice(F.array_sort(F.array_union(F.slice(va, 1, k), F.slice(vb, 1, k))), 1, k)
        shared = F.size(F.array_intersect(low, F.array_intersect(F.slice(va, 1, k), F.slice(vb, 1, k))))
        likely = shared >= share * F.size(low)
    meet = F.size(F.array_intersect(va, vb))
    exact = 100 * meet >= threshold_pct * (F.size(va) + F.size(vb) - meet)
    return both.filter(fits).filter(likely).filter(exact).select("a", "b")


def _blocks(threshold_pct: int, wide: int | None):
    """applyInPandas function: links and open pairs across components, of one block, or two, of a long list.

    Rows hold the ``wide`` smallest hashes of their sets, or all. Where that is both whole
    sets, overlaps counted for a row against all others at once are exact, and
    only links that join two parts of the block go on. Other pairs go on where
    the union-sketch estimate allows it, from the list of their smallest common
    value only.
    """
    share = needed_share(threshold_pct, wide)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, v = int(rows["i"].iloc[0]), int(rows["j"].iloc[0]), int(rows["v"].iloc[0])
        sketch = list(rows["vals"])
        held = np.array([len(s) for s in sketch])
        size = rows["size"].to_numpy()
        whole = size <= wide if wide else np.ones(len(size), dtype=bool)
        flat = np.concatenate(sketch)
        owner = np.repeat(np.arange(len(rows)), held)
        order = np.argsort(flat, kind="stable")
        ranked, holder = flat[order], owner[order]
        cuts = np.flatnonzero(np.diff(ranked, prepend=ranked[0] - 1))
        ends = np.append(cuts[1:], len(ranked))
        of_value = np.empty(len(flat), dtype=np.int64)
        of_value[order] = np.repeat(np.arange(len(cuts)), ends - cuts)
        where = np.concatenate([[0], np.cumsum(held)])
        _, part = np.unique(np.array([bytes(x).hex() for x in rows["root"]]), return_inverse=True)
        block, fp = rows["blk"].to_numpy(), [bytes(x) for x in rows["fp"]]
        listed = [frozenset(x) for x in rows["pre"]]
        out = []
        for r in range(len(rows)):
            mine = of_value[where[r] : where[r + 1]]
            meet = np.bincount(np.concatenate([holder[cuts[g] : ends[g]] for g in mine]), minlength=len(rows))
            later = np.arange(len(rows)) > r
            if i != j:
                later &= block != block[r]
            linked = later & whole & whole[r] & (100 * meet >= threshold_pct * (size + size[r] - meet))
            for o in np.flatnonzero(linked):
                if part[o] != part[r]:
                    part[part == part[o]] = part[r]
                    out.append((min(fp[r], fp[o]), max(fp[r], fp[o]), True))
            fits = 100 * np.minimum(size, size[r]) >= threshold_pct * np.maximum(size, size[r])
            likely = later & ~(whole & whole[r]) & fits & (meet >= share * np.minimum(held, held[r])) & (part != part[r])
            for o in np.flatnonzero(likely):
                if min(listed[r] & listed[o]) != v:
                    continue
                low = np.union1d(sketch[r], sketch[o])[:wide]
                both = np.intersect1d(sketch[r], sketch[o], assume_unique=True)
                if np.searchsorted(both, low[-1], side="right") >= share * len(low):
                    out.append((min(fp[r], fp[o]), max(fp[r], fp[o]), False))
        return pd.DataFrame(out, columns=["a", "b", "sure"])

    return run


def _links(lists: DataFrame, sets: DataFrame, threshold_pct: int, k: int | None, share: float) -> DataFrame | None:
    """(node, root) of all nodes with links. lists: (v, fp), a row for each list that a node stands in."""
    edges, roots = None, None
    left = lists.withColumn("root", F.col("fp"))
    done = None
    for step in range(ROUNDS + 1):
        ends = left.groupBy("v").agg(F.min(F.struct("root", "fp")).alias("lo"), F.max(F.struct("root", "fp")).alias("hi"), F.count(F.lit(1)).alias("m"))
        # a hot value's rows are split between tasks only if the aggregate does not come dealt by value
        ends = written(ends.filter(F.col("lo.root") != F.col("hi.root")))
        left = cut(left.join(ends.select("v", F.col("lo.fp" if step % 2 == 0 else "hi.fp").alias("head"), F.col("lo.root" if step % 2 == 0 else "hi.root").alias("hroot"), "m"), "v"))
        if step == ROUNDS:
            break
        pairs = left.filter("root <> hroot").select(F.least("fp", "head").alias("a"), F.greatest("fp", "head").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        if not pairs.limit(1).count():
            break
        done = pairs if done is None else done.union(pairs)
        found = _verified(pairs, sets, threshold_pct, k, share)
        edges = cut(found if edges is None else edges.union(found))
        roots = components(edges)
        base = left.select("v", "fp")
        left = base.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("v", "fp", F.coalesce("root", "fp").alias("root"))
    rest = left.filter("m > 2")
    short = rest.filter(F.col("m") <= SHORT).select("v", "fp", "root", "head")
    one = short.select("v", F.col("fp").alias("a"), F.col("root").alias("ra"), "head")
    two = short.select("v", F.col("fp").alias("b"), F.col("root").alias("rb"))
    near = one.join(two, "v").filter("a < b AND ra <> rb").select("a", "b").distinct()
    long = rest.filter(F.col("m") > SHORT)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    long = long.select("v", "fp", "root", mine.alias("blk"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    long = long.select("v", "fp", "root", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))
    stands = lists.groupBy("fp").agg(F.collect_list("v").alias("pre"))  # at most k values
    least = None if k is None else WIDE
    wide = sets.select("fp", F.size("vals").alias("size"), (F.slice("vals", 1, least) if least else F.col("vals")).alias("vals")).join(stands, "fp")
    # blocks are small in bytes and long in work: as many tasks as the session has partitions, which are not put together
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = cut(long.join(wide, "fp").repartition(parts, "v", "i", "j").groupBy("v", "i", "j").applyInPandas(tidy_group(_blocks(threshold_pct, least)), "a binary, b binary, sure boolean").distinct())
    pairs = near.union(far.filter("NOT sure").select("a", "b")).distinct()
    if done is not None:
        pairs = pairs.join(done, ["a", "b"], "left_anti")
    found = cut(_verified(pairs, sets, threshold_pct, k, share).union(far.filter("sure").select("a", "b")))
    if not found.limit(1).count():
        return roots
    return components(found if edges is None else edges.union(found))


def _full_sets(docs: DataFrame, lists: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """fp and the whole set of every node that stands in a list, from one document of each."""
    wanted = cut(lists.select("fp").distinct().join(nodes.select("fp", "least"), "fp"))
    ids = wanted.filter("least IS NOT NULL").select(F.col("least").alias("_least")).distinct()
    ids = F.broadcast(ids) if wanted.count() <= BROADCAST_ROWS else ids
    texts = docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    texts = texts.join(ids, F.col("rid") == F.col("_least"), "left_semi").union(texts.filter("rid IS NULL"))
    full = shingle_rows(texts, "rid", "text", shingle, None).join(wanted.select("fp"), "fp", "left_semi")
    return cut(full.groupBy("fp").agg(F.first("vals").alias("vals")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold_pct: int = 80, k: int | None = 64) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Rows are linked when 100 * |A and B| >= threshold_pct * |A or B| for their
    sets of ``shingle``-word shingles (A-Z lower-cased, words between ASCII
    white space; the whole sequence if there are fewer words). component_id is
    the smallest id that links lead to; kept marks the rows that bear it.

    With ``k`` values retained of each set a link at the threshold is missed with
    a chance of about 1e-8, for each of the lists that it may be found in; with
    ``k`` None all values are retained and no link is missed, at the cost of
    longer lists.

    Null and empty texts, and texts of white space, have n_shingles 0 and stand
    alone. Rows with equal ids are judged each by its own text. A component
    whose rows all lack an id, and an empty text without one, has component_id
    null and is kept. Other columns are ignored; an empty table gives no rows.
    """
    share = needed_share(threshold_pct, k)
    rows = cut(shingle_rows(docs, id_col, text_col, shingle, k))
    nodes = rows.filter("n > 0").groupBy("fp").agg(F.min("rid").alias("least"), F.first("vals").alias("vals"))
    nodes = cut(nodes)
    postings = nodes.select("fp", F.size("vals").alias("s"), F.explode("vals").alias("v"))
    common = postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = postings.join(common, "v").groupBy("fp").agg(F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    # values of no other node are rarer than these and take the first places
    take = F.size("held") - F.ceil(share * F.col("s")).cast("int") + 1
    lists = cut(met.filter(take > 0).select("fp", F.explode(F.slice("held", 1, take)).alias("x")).select(F.col("x.v").alias("v"), "fp"))
    sets = _full_sets(docs, lists, nodes, id_col, text_col, shingle)
    roots = _links(lists, sets, threshold_pct, k, share)
    least = nodes.select("fp", "least")
    if roots is not None:
        least = cut(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
        ids = written(least.groupBy("root").agg(F.min("least").alias("component_id")))
        least = least.join(ids, "root").select("fp", "component_id")
    else:
        least = least.withColumnRenamed("least", "component_id")
    out = rows.select("rid", "n", "fp").join(least, "fp", "left")
    comp = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("rid"))
    return out.select(F.col("rid").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("rid").eqNullSafe(comp).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id.

    Rows without an id are never dropped; of rows repeated with one id all stay or all go.
    Null and empty texts are linked with nothing and stay. An empty table gives
    no rows. All columns stay as they are, whatever their names.
    """
    name = spare_name(docs, "_gone")
    gone = cut(near_duplicates(docs, id_col, text_col, **options).filter(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias(name)).distinct())
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, F.col(id_col) == F.col(name), "left_anti")
