"""Embedding near-dedup over an inverted multi-index.

Unit vectors are cut in halves and each half has a codebook of its own; the
pairs of nearest codewords form a grid of cells. A vector lives in its nearest
cell and visits the cells in the order of their summed distances, a traversal of
two sorted lists, until its distance budget is spent. The budget is set on a
sample, so that the wanted share of neighbours at exactly the threshold is
found. Residents and visitors of a cell are then compared by their cosines.

Equal vectors fold into one node first. In cells of very many rows, balls of
vectors around a leader are found whose members are all linked with one another:
they count each other by their number and are compared with other rows only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.hard_negatives import dense, finite
from plumbline.llm.tokens import tidy, tidy_group
from plumbline.session import cut, written

#: Vectors of a cell, about, if all cells were alike: the grid grows with the table.
CELL_ROWS = 2048
#: Codewords of a half at most; beyond CELL_ROWS * MAX_CODES**2 vectors cells get fuller, and are compared in blocks.
MAX_CODES = 1024
#: Vectors, about, that codebooks and budget are fitted on; taken by their hash.
SAMPLE = 16_384
#: Residents or visitors of a cell that are compared at once; a ball counts from this size on.
BLOCK = 1024
#: Rows of a full cell that are tried as leaders of balls.
LEADERS = 32
#: Share of neighbours at the threshold that the budget finds.
RECALL = 0.995


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length one; those of largest components far from one are scaled first, so that no square leaves the doubles."""
    matrix = matrix / np.maximum(np.abs(matrix).max(axis=1, keepdims=True, initial=0), 1e-300)
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1), 0)


def _codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means from rows drawn by a fixed seed."""
    codes = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(12):
        mine = _squares(x, codes).argmin(axis=1)
        count = np.bincount(mine, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, mine, x)
        codes[count > 0] = sums[count > 0] / count[count > 0, None]
    return codes


class Grid:
    """Two codebooks, the cells of their product, and the distance budget of a visit."""

    def __init__(self, left: np.ndarray, right: np.ndarray, budget: float = 0.0):
        self.left, self.right, self.budget = left, right, budget

    def over(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How much further than the nearest one each codeword is, for both halves of each row."""
        half = self.left.shape[1]
        a, b = _squares(x[:, :half], self.left), _squares(x[:, half:], self.right)
        return a - a.min(axis=1, keepdims=True), b - b.min(axis=1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.over(x)
        return a.argmin(axis=1) * len(self.right) + b.argmin(axis=1)

    def cost(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """What a visit of ``cell[i]`` takes from the budget of row i."""
        a, b = self.over(x)
        at = np.arange(len(x))
        return a[at, cell // len(self.right)] + b[at, cell % len(self.right)]

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all visits, each row's nearest cells first.

        Both lists of distances are sorted; step by step along the first one goes
        as far into the second as the budget lasts, for all rows at once.
        """
        a, b = self.over(x)
        by_a, by_b = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
        a, b = np.take_along_axis(a, by_a, 1), np.take_along_axis(b, by_b, 1)
        rows, cells, costs = [], [], []
        for i in range(a.shape[1]):
            live = np.flatnonzero(a[:, i] <= self.budget)
            if not len(live):
                break
            left = self.budget - a[live, i]
            r, j = np.nonzero(b[live] <= left[:, None])
            rows.append(live[r])
            cells.append(by_a[live[r], i] * len(self.right) + by_b[live[r], j])
            costs.append(a[live[r], i] + b[live[r], j])
        row, cell, cost = np.concatenate(rows), np.concatenate(cells), np.concatenate(costs)
        order = np.lexsort((cost, row))
        return row[order], cell[order]


def fit_grid(x: np.ndarray, labels: np.ndarray, rows: int, threshold: float, recall: float, cell_rows: int = CELL_ROWS) -> Grid:
    """Codebooks and budget from a sample of unit vectors of a table of ``rows`` rows.

    The budget finds the share ``recall`` of made-up neighbours at exactly the
    threshold in random directions, and of the sample's own pairs above it.
    """
    k = max(1, min(MAX_CODES, len(x), math.ceil(math.sqrt(rows / cell_rows))))
    half = x.shape[1] // 2
    grid = Grid(_codebook(x[:, :half], k, 1), _codebook(x[:, half:], k, 2))
    some = x[:4096]
    aside = np.random.default_rng(3).standard_normal(some.shape)
    aside = unit(aside - (aside * some).sum(axis=1, keepdims=True) * some)
    near = threshold * some + math.sqrt(max(0.0, 1 - threshold * threshold)) * aside
    tries = [(some, near)]
    same = np.triu((some @ some.T >= threshold) & (labels[:4096, None] == labels[:4096]), 1)
    i, j = np.nonzero(same)
    if len(i):
        pick = np.random.default_rng(4).permutation(len(i))[:4096]
        tries.append((some[i[pick]], some[j[pick]]))
    for one, two in tries:
        needs = np.minimum(grid.cost(one, grid.home(two)), grid.cost(two, grid.home(one)))
        grid.budget = max(grid.budget, float(np.quantile(needs, recall)) + 1e-9)
    return grid


def _visits(shared, dims: int):
    """mapInArrow function: (fp, unit, label, m, v) to one row for each cell visited."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(dense(batch.column("v"), dims))
            row, cell = grid.visits(x)
            home = grid.home(x)
            kept = pa.Table.from_batches([batch]).take(pa.array(row)).combine_chunks()
            yield from kept.append_column("cell", pa.array(cell)).append_column("home", pa.array(home[row])).to_batches()

    return run


def _homes(shared, dims: int):
    """mapInArrow function: (fp, label, v) with each row's own cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cell", pa.array(shared.value.home(unit(dense(batch.column("v"), dims))))) if batch.num_rows else batch.append_column("cell", pa.array([], pa.int64()))

    return run


def _stack(column: pd.Series, dims: int) -> np.ndarray:
    return unit(dense(pa.array(column.tolist(), pa.list_(pa.float64())), dims))


def _leader_of(dims: int, least: float):
    """applyInPandas function over a piece of a full cell and the cell's candidates: the leader of each row that is within reach of one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lead = rows[rows["leads"]].sort_values("fp")
        rest = rows[~rows["leads"]]
        x, y = _stack(lead["v"], dims), _stack(rest["v"], dims)
        kept = []
        for i in range(len(x)):  # at most LEADERS
            if not kept or (x[kept] @ x[i]).max() < least:
                kept.append(i)
        near = y @ x[kept].T
        best = near.argmax(axis=1)
        within = near[np.arange(len(y)), best] >= least
        names = lead["fp"].to_numpy()[kept]
        return pd.DataFrame({"fp": rest["fp"].to_numpy()[within], "ball": names[best[within]]})

    return run


def _balls(nodes: DataFrame, shared, dims: int, threshold: float, block: int) -> DataFrame | None:
    """(fp, ball, ball_m) of the members of balls of ``block`` rows or more; None without full cells."""
    homes = cut(nodes.select("fp", "label", "v").mapInArrow(tidy(_homes(shared, dims)), f"fp binary, label long, v {nodes.schema['v'].dataType.simpleString()}, cell long"))
    full = cut(homes.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block))
    if not full.limit(1).count():
        return None
    rows = homes.join(full, ["label", "cell"])
    pieces = F.ceil(F.col("n") / block).cast("int")
    place = F.row_number().over(Window.partitionBy("label", "cell").orderBy(F.xxhash64("fp"), "fp"))
    lead = rows.withColumn("place", place).filter(F.col("place") <= LEADERS)
    lead = lead.select("label", "cell", "fp", "v", F.lit(True).alias("leads"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    rest = rows.select("label", "cell", "fp", "v", F.lit(False).alias("leads"), F.pmod(F.xxhash64("fp"), pieces).cast("int").alias("piece"))
    # two members within half the angle of their leader are within the angle of each other
    least = math.cos(math.acos(threshold) / 2) + 1e-9
    found = cut(rest.union(lead).groupBy("label", "cell", "piece").applyInPandas(tidy_group(_leader_of(dims, least)), "fp binary, ball binary"))
    sizes = found.join(nodes.select("fp", "m"), "fp").groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("ball_m")).filter(F.col("n") >= block)
    return cut(found.join(sizes.drop("n"), "ball"))


def _compared(shared, dims: int, threshold: float):
    """applyInPandas function over some residents and visitors of a cell.

    A visitor counts the residents that it is linked with; a resident counts the
    visitor only where it does not visit the visitor's home, which would find
    the pair once more. Links are given as a forest over units.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grid = shared.value
        stays, comes = rows[rows["stays"]], rows[~rows["stays"]]
        if not len(stays) or not len(comes):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        x, y = _stack(comes["v"], dims), _stack(stays["v"], dims)
        fx, fy = comes["fp"].to_numpy(), stays["fp"].to_numpy()
        linked = x @ y.T >= threshold
        linked &= fx[:, None] != fy[None, :]
        i, j = np.nonzero(linked)
        n = np.zeros((2, max(len(x), len(y))), np.int64)
        np.add.at(n[0], i, stays["m"].to_numpy()[j])
        home = comes["home"].to_numpy()
        for at in range(0, len(i), 1 << 14):
            p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            alone = grid.cost(y[q], home[p]) > grid.budget
            np.add.at(n[1], q[alone], comes["m"].to_numpy()[p[alone]])
        names, part = np.unique(np.concatenate([comes["unit"].to_numpy(), stays["unit"].to_numpy()]), return_inverse=True)
        px, py = part[: len(x)], part[len(x) :]
        group = np.arange(len(names))
        edges = []
        for r in np.flatnonzero(linked.any(axis=1)):
            met = group[py[linked[r]]]
            for other in np.unique(met[met != group[px[r]]]):
                edges.append((names[px[r]], names[py[np.flatnonzero(linked[r])[np.flatnonzero(met == other)[0]]]], 0))
                group[group == other] = group[px[r]]
        counts = [(f, None, int(c)) for f, c in zip(fx, n[0], strict=False) if c] + [(f, None, int(c)) for f, c in zip(fy, n[1], strict=False) if c]
        return pd.DataFrame(edges + counts, columns=["a", "b", "n"])

    return run


def _pairs(visits: DataFrame, shared, dims: int, threshold: float, block: int) -> DataFrame:
    """Links (a, b) of units, and counts (a, null, n) of nodes, from all cells. Fuller cells are dealt in blocks of residents and visitors."""
    key = ["label", "cell"]
    kinds = visits.groupBy(*key, "ball").agg(F.count_if(F.col("cell") == F.col("home")).alias("stay"), F.count(F.lit(1)).alias("come"))
    blocks = {s: F.greatest(F.ceil(F.col(s) / block).cast("int"), F.lit(1)) for s in ("stay", "come")}
    kinds = cut(kinds.select(*key, "ball", "stay", blocks["stay"].alias("stay_n"), blocks["come"].alias("come_n")))

    def numbered(side: str) -> DataFrame:
        held = kinds.filter("stay > 0") if side == "stay" else kinds
        return held.select(*key, F.col("ball").alias(f"{side}_ball"), F.explode(F.sequence(F.lit(0), F.col(f"{side}_n") - 1)).alias(f"{side}_at"))

    # members of one ball are all linked: no block of it meets another
    turns = numbered("stay").join(numbered("come"), key).filter("stay_ball IS NULL OR come_ball IS NULL OR stay_ball <> come_ball")
    turns = cut(turns)
    none = F.lit("none").cast("binary")
    rows = visits.withColumn("kind", F.coalesce("ball", none)).join(kinds.select(*key, F.coalesce("ball", none).alias("kind"), "stay_n", "come_n"), [*key, "kind"])

    def dealt(side: str) -> DataFrame:
        mine = rows.filter("cell = home") if side == "stay" else rows
        mine = mine.withColumn(f"{side}_at", F.pmod(F.xxhash64("fp"), F.col(f"{side}_n")).cast("int"))
        met = turns.withColumn("kind", F.coalesce(f"{side}_ball", none))
        return mine.select(*key, "kind", f"{side}_at", "fp", "unit", "m", "v", "home").join(met, [*key, "kind", f"{side}_at"]).withColumn("stays", F.lit(side == "stay"))

    by = [*key, "stay_ball", "stay_at", "come_ball", "come_at"]
    names = [*by, "fp", "unit", "m", "v", "home", "stays"]
    every = dealt("stay").select(*names).union(dealt("come").select(*names))
    return cut(every.groupBy(*by).applyInPandas(tidy_group(_compared(shared, dims, threshold)), "a binary, b binary, n long"))


def fingerprint(label: Column, vector: Column) -> Column:
    """128 bits of a label and a vector, from two hashes that begin differently."""
    halves = [F.lpad(F.hex(F.xxhash64(*c)), 16, "0") for c in ((label, vector), (F.lit(1), vector, label))]
    return F.unhex(F.concat(*halves))


def vector_duplicates(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", threshold: float = 0.93, recall: float = RECALL, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Rows of equal labels are linked when their cosine is ``threshold`` or more,
    in doubles; no other pair is ever linked. Of the pairs at the threshold the
    share ``recall`` is looked for, of closer ones more; ``recall=1`` takes the
    budget of the hardest pair of the sample. n_links counts the other rows that
    a row is linked with, component_id is the smallest id that links lead to,
    kept marks the rows that bear it.

    Null labels, null and zero vectors, and those with null or non-finite
    components are linked with nothing and are their own component. Shorter
    vectors count as filled up with zeros. Rows that share an id are rows of
    their own; a component whose rows all lack an id has component_id null and
    is kept. Other columns are ignored; an empty table gives no rows.

    Codebooks and budget are fitted on about SAMPLE vectors; every vector is
    indexed. Only the codebooks are broadcast, at most MAX_CODES * dims numbers.
    Cells, visits and links stay in tables; no task holds more than ``block``
    residents and as many visitors.
    """
    spark = vectors.sparkSession
    label, v = F.col(label_col).cast("long"), F.col(vec_col)
    usable = label.isNotNull() & finite(v) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), v.alias("v"), F.when(usable, fingerprint(label, v)).alias("fp"))
    nodes = cut(rows.filter("fp IS NOT NULL").groupBy("fp").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("m"), F.min("id").alias("least")))
    total = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    n, dims = total["n"], max(2, total["d"] or 0)
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    sample = nodes.filter(F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(max(1, n))) < SAMPLE).select("fp", "label", "v").toPandas().sort_values("fp")
    if not len(sample):
        sample = nodes.limit(1).select("fp", "label", "v").toPandas()
    grid = fit_grid(_stack(sample["v"], dims), sample["label"].to_numpy(), n, threshold, recall, cell_rows)
    shared = spark.sparkContext.broadcast(grid)
    balls = _balls(nodes, shared, dims, threshold, block)
    none = F.lit(None).cast("binary")
    held = nodes.withColumns({"ball": none, "ball_m": F.lit(None).cast("long")}) if balls is None else nodes.join(balls, "fp", "left")
    held = held.withColumn("unit", F.coalesce("ball", "fp"))
    kind = nodes.schema["v"].dataType.simpleString()
    fields = f"fp binary, unit binary, ball binary, label long, m long, v {kind}, cell long, home long"
    visits = held.select("fp", "unit", "ball", "label", "m", "v").mapInArrow(tidy(_visits(shared, dims)), fields)
    found = _pairs(visits, shared, dims, threshold, block)
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("n"))
    known = held.select("fp", "unit", "m", "ball_m", "least").join(links, "fp", "left")
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    known = cut(known.join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("root", F.coalesce("root", "unit")))
    ids = written(known.groupBy("root").agg(F.min("least").alias("component_id")))
    count = F.coalesce("ball_m", "m") - 1 + F.coalesce("n", F.lit(0))
    known = known.join(ids, "root").select("fp", count.alias("n_links"), "component_id")
    out = rows.select("id", "fp").join(known, "fp", "left")
    least = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), least.alias("component_id"), F.col("id").eqNullSafe(least).alias("kept"))
