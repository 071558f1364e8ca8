"""A stored vector index: coarse cells of unit vectors, and an exact ranking of what the probed cells hold.

An index is a folder of versions, each a Parquet table parted by cell, and a
manifest that names the current one. A new version is written beside the old
one and becomes current when the manifest is replaced, so readers never see
half of it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import open_fs

#: Cells of an index at most, vectors that they are fitted on, and asked of for the number of probes.
MOST_CELLS, SAMPLE, ASKED = 1024, 20_000, 256
#: Rows of a cell, and queries, that one task compares.
CHUNK, TURN = 16_384, 2048
MANIFEST = "manifest.json"


def _unit(rows: list | pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in rows], dtype=np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _cells(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of unit vectors, moved towards their members a fixed number of times."""
    centres = x[np.random.default_rng(0).permutation(len(x))[:k]].copy()
    for _ in range(10):
        mine = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def _probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many cells must be probed to find the share ``recall`` of the k nearest, by a sample against itself."""
    asked = x[:ASKED]
    score = asked @ x.T
    np.fill_diagonal(score[:, : len(asked)], -2)
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not near.size:
        return 1
    home = (x @ centres.T).argmax(axis=1)
    order = np.argsort(-(asked @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needs = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(needs[min(len(needs) - 1, math.ceil(recall * len(needs)) - 1)]) + 1


def read_manifest(path: str) -> dict | None:
    fs, root = open_fs(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type != pafs.FileType.File:
        return None
    with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def build_index(vectors: DataFrame, path: str, id_col: str, vec_col: str, cells: int | None = None, k: int = 10, recall: float = 0.95) -> dict:
    """Write a new version of the index under ``path`` and make it current; returns its manifest.

    Rows without a vector are left out; vectors of different lengths are an
    error. Cells and probes are fitted on at most SAMPLE vectors, taken by a hash
    of their ids; every vector is indexed.
    """
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if seen["n"] and seen["low"] != seen["high"]:
        raise ValueError(f"vectors have {seen['low']} to {seen['high']} dimensions")
    n, dims = seen["n"], seen["high"] or 0
    held = rows.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n))) < SAMPLE).limit(2 * SAMPLE).toPandas() if n else pd.DataFrame({"id": [], "v": []})
    if n and not len(held):
        held = rows.limit(SAMPLE).toPandas()
    x = _unit(held["v"]) if n else np.zeros((0, 0))
    wanted = min(cells or max(1, round(math.sqrt(n) / 2)), MOST_CELLS, max(1, len(x)))
    centres = _cells(x, wanted) if n else np.zeros((0, 0))
    before = read_manifest(path)
    version = (before["version"] if before else 0) + 1
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield b.append_column("cell", pa.array((_unit(list(flat)) @ shared.value.T).argmax(axis=1).astype(np.int32)))

    kind = rows.schema["id"].dataType.simpleString()
    folder = f"{path.rstrip('/')}/version={version}"
    # rows of a cell come together, so that a task writes few files
    rows.mapInArrow(placed, f"id {kind}, v array<double>, cell int").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(folder)
    counts = {str(r["cell"]): r["n"] for r in vectors.sparkSession.read.schema(f"id {kind}, v array<double>, cell int").parquet(folder).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()} if n else {}
    manifest = {"version": version, "dims": dims, "rows": n, "id": kind, "k": k, "recall": recall, "probes": _probes(x, centres, k, recall) if n else 0, "counts": counts, "centres": centres.tolist()}
    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}.new") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")
    return manifest


def ensure_index(vectors: DataFrame, path: str, id_col: str, vec_col: str, **options) -> dict:
    """The current manifest; the index is built where there is none, or where the vectors have other dimensions than it has."""
    found = read_manifest(path)
    first = vectors.filter(F.col(vec_col).isNotNull()).select(F.size(vec_col).alias("d")).first()
    if found is None or (first is not None and first["d"] != found["dims"]):
        return build_index(vectors, path, id_col, vec_col, **options)
    return found


def drop_index(path: str) -> None:
    fs, root = open_fs(path)
    if fs.get_file_info(root).type == pafs.FileType.Directory:
        fs.delete_dir(root)


def search_index(spark: SparkSession, path: str, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query, neighbour, score, rank): the k nearest stored vectors by cosine, among those of the ``probes`` nearest cells; a vector is not its own neighbour.

    Scores have six decimals, ties go to the smaller id. Only probed cells are
    read, full ones in chunks; every chunk hands on k rows a query. All cells
    probed, the answer is exact.
    """
    m = read_manifest(path)
    kind = queries.select(id_col).schema[0].dataType.simpleString()
    found = f"query {kind}, neighbour {m['id']}, score double"
    if not m["rows"]:
        return spark.createDataFrame([], found).withColumn("rank", F.lit(1))
    centres, take = np.array(m["centres"]), min(probes or m["probes"], len(m["centres"]))
    shared = spark.sparkContext.broadcast(centres)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                near = np.argsort(-(_unit(list(flat)) @ shared.value.T), axis=1, kind="stable")[:, :take]
                row = pa.array(np.repeat(np.arange(b.num_rows), take))
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(near.ravel().astype(np.int32))], names=["query", "q", "cell"])

    asked = queries.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("query"), F.col(vec_col).cast("array<double>").alias("q")).mapInArrow(probed, f"query {kind}, q array<double>, cell int")
    turns = max(1, -(-queries.count() // TURN))
    # one number for each cell, MOST_CELLS at most
    chunks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, n in m["counts"].items() for x in (int(c), -(-n // CHUNK))]), F.col("cell")), F.lit(1))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("query"), F.lit(turns)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
    stored = spark.read.schema(f"id {m['id']}, v array<double>, cell int").parquet(f"{path.rstrip('/')}/version={m['version']}").filter(F.col("cell").isin(cells))
    stored = stored.withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def best(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query": [], "neighbour": [], "score": []})
        rows = rows.sort_values("id", kind="stable")
        ids = rows["id"].to_numpy()
        score = np.round(_unit(wanted["q"]) @ _unit(rows["v"]).T, 6)
        score[wanted["query"].to_numpy()[:, None] == ids[None, :]] = -2
        top = np.argsort(-score, axis=1, kind="stable")[:, :k]
        held = np.take_along_axis(score, top, axis=1)
        q, ok = np.repeat(wanted["query"].to_numpy(), top.shape[1]), held.ravel() > -2
        return pd.DataFrame({"query": q[ok], "neighbour": ids[top.ravel()[ok]], "score": held.ravel()[ok]})

    by = ["cell", "chunk", "turn"]
    pairs = stored.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(best, found)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
