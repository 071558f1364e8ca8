"""The stored vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import vector_index
from plumbline.operators.retrieval import cosine_topk

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").cache()


def pairs(rows):
    return {(r["query"], r["neighbour"]) for r in rows.collect()}


def test_recall_and_exact_way(spark, vectors, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    made = vector_index.build_index(vectors, path, "vec_id", "embedding")
    assert made["rows"] == 500 and sum(made["counts"].values()) == 500 and 1 <= made["probes"] <= len(made["centres"])
    asked = vectors.filter("vec_id % 10 = 0")
    exact = cosine_topk(vectors, asked, "vec_id", "embedding", k=10)
    found = vector_index.search_index(spark, path, asked, "vec_id", "embedding")
    assert len(pairs(exact) & pairs(found)) >= 0.9 * len(pairs(exact))
    monkeypatch.setattr(vector_index, "CHUNK", 7)
    monkeypatch.setattr(vector_index, "TURN", 9)
    whole = vector_index.search_index(spark, path, asked, "vec_id", "embedding", probes=10_000)
    key = lambda rows: sorted((r["query"], r["rank"], r["neighbour"], r["score"]) for r in rows.collect())
    assert key(whole) == key(exact)


def test_clusters_need_few_probes(spark, tmp_path):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] + 0.05 * draw.normal(size=16)]) for i in range(4000)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    path = str(tmp_path / "index")
    made = vector_index.build_index(table, path, "id", "v", cells=40)
    assert made["probes"] <= 8
    asked = table.filter("id % 100 = 0")
    exact, found = pairs(cosine_topk(table, asked, "id", "v", k=10)), pairs(vector_index.search_index(spark, path, asked, "id", "v"))
    assert len(exact & found) >= 0.9 * len(exact)


def test_versions_and_dimensions(spark, vectors, tmp_path):
    path = str(tmp_path / "index")
    assert vector_index.ensure_index(vectors, path, "vec_id", "embedding")["version"] == 1
    assert vector_index.ensure_index(vectors, path, "vec_id", "embedding")["version"] == 1
    half = vectors.withColumn("embedding", F.slice("embedding", 1, 32))
    again = vector_index.ensure_index(half, path, "vec_id", "embedding", cells=3)
    assert (again["version"], again["dims"], len(again["centres"])) == (2, 32, 3)
    assert vector_index.search_index(spark, path, half.limit(2), "vec_id", "embedding", k=3).count() == 6
    with pytest.raises(ValueError, match="dimensions"):
        vector_index.build_index(vectors.union(half), path, "vec_id", "embedding")
    vector_index.drop_index(path)
    assert vector_index.read_manifest(path) is None


def test_empty_and_null_vectors(spark, tmp_path):
    path = str(tmp_path / "index")
    table = spark.createDataFrame([("a", None), ("b", [1.0, 0.0]), ("c", [0.0, 0.0]), ("d", [1.0, 1.0])], "id string, v array<double>")
    vector_index.build_index(table, path, "id", "v")
    got = vector_index.search_index(spark, path, table, "id", "v", k=2, probes=99).filter("query = 'b'").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == ["d", "c"]
    vector_index.build_index(table.limit(0), path, "id", "v")
    assert vector_index.search_index(spark, path, table, "id", "v").count() == 0
