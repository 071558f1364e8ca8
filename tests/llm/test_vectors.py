"""Importance resampling, hard negatives and embedding dedup against plain versions, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import vector_dedup
from plumbline.llm.hard_negatives import hard_negatives
from plumbline.llm.importance import importance_scores, resample
from plumbline.llm.queries import op11_importance, op12_hard_negatives, op13_vector_dedup
from plumbline.llm.vector_dedup import fit_grid, unit, vector_duplicates

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VECTORS = "vec_id long, label int, embedding array<float>, n int, score long, fp string"


def gains_by_force(docs, target, least=20, pct=5, buckets=10_000):
    """{row number: (n_features, weight, score, rank)} for docs [(id, text)]."""

    def features(text):
        words = TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)

    each = [features(t) for _, t in docs]
    raw, aim = Counter(b for f, _ in each for b in f), Counter(b for t in target for b in features(t)[0])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in raw}
    out = []
    for (i, _), (f, _) in zip(docs, each, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((n for n in range(len(docs)) if each[n][1] >= least), key=lambda n: (-out[n][2], docs[n][0]))
    place = {n: k + 1 for k, n in enumerate(fit[: pct * len(fit) // 100])}
    return [(*o, place.get(n)) for n, o in enumerate(out)]


def test_importance(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = gains_by_force(docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in op11_importance(spark, SF).collect()}
    assert got == {i: w for (i, _), w in zip(docs, want, strict=True)}


def test_importance_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    same = "The same words, ÄPFEL und Birnen " * 6
    rows = [(1, long), (2, same), (3, same), (3, same), (3, "other"), (4, None), (5, ""), (6, " ,. "), (7, "a"), (8, "a b"), (None, same)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, rid int, score int, bucket string")
    aims = spark.createDataFrame([(1, "und birnen"), (2, None)], "item_id long, text string")
    got = importance_scores(docs, aims, draw_pct=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = gains_by_force(rows[:-1] + [(0, same)], ["und birnen", None], pct=50)
    key = lambda n, w: (n, w)
    assert sorted(key(r.n_features, r.weight) for r in got.collect()) == sorted(key(*w[:2]) for w in want)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2]
    drawn = resample(docs, aims, draw_pct=50)
    assert drawn.columns == docs.columns and drawn.filter("text = ''").count() == 0
    assert importance_scores(docs.limit(0), aims).count() == 0
    assert {r.weight for r in importance_scores(docs, aims.limit(0)).filter("n_features = 0").collect()} == {0}


def negatives_by_force(rows, k=5):
    whole = {n: [math.floor(256 * x) for x in v] for n, (_, _, v) in enumerate(rows)}
    out = []
    for a, (i, label, _) in enumerate(rows):
        if i % 100:
            continue
        score = {n: sum(x * y for x, y in zip(whole[a], whole[n], strict=False)) for n in whole}
        first = lambda which: sorted(which, key=lambda n: (-score[n], rows[n][0]))[:k]  # noqa: B023, E731
        for p in first([n for n in whole if rows[n][1] == label and rows[n][0] != i]):
            low = [n for n in whole if rows[n][1] != label and 80 * score[p] <= 100 * score[n] <= 100 * score[p]]
            out += [(i, rows[p][0], r + 1, rows[n][0], score[p], score[n]) for r, n in enumerate(first(low))]
    return sorted(out)


def moved(rows):
    return [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows]


def test_hard_negatives(spark):
    rows = moved([(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()])
    want = negatives_by_force(rows)
    got = op12_hard_negatives(spark, SF)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == want


def test_hard_negatives_in_blocks_with_ties_and_odd_rows(spark):
    draw = np.random.default_rng(7)
    rows = [(int(i), int(draw.integers(3)), [float(x) for x in draw.normal(size=8).round(1)]) for i in range(900)]
    rows += [(1000 + i, i % 2, rows[i % 5][2]) for i in range(40)]
    rows += [(100, 1, rows[100][2]), (2000, 0, [1.0, 1.0]), (2001, 1, []), (3000, 2, [1e30] * 8), (3001, 1, [1e-30] * 8)]
    bad = [(None, 1, rows[0][2]), (4000, None, rows[0][2]), (4100, 1, None), (4200, 1, [float("nan")] * 8), (4300, 1, [None] * 8), (4400, 1, [float("inf")] * 8)]
    want = negatives_by_force([(i, lab, ([min(x, 65536.0) for x in v] + [0.0] * 8)[:8]) for i, lab, v in rows])
    table = spark.createDataFrame([(i, lab, v, 1, 2, "x") for i, lab, v in rows + bad], VECTORS)
    got = hard_negatives(table, "vec_id % 100 = 0", anchors_at_once=3)
    assert sorted(tuple(r) for r in got.collect()) == want
    alike = hard_negatives(table.union(table.filter("vec_id = 200")), "vec_id = 200").collect()
    assert len(alike) == 2 * len(set(alike)) > 0
    assert hard_negatives(table.limit(0), "vec_id % 100 = 0").count() == 0
    assert hard_negatives(table, "vec_id < 0").count() == 0


def links_by_force(rows, threshold):
    """[(n_links, root)] for rows [(id, label, vector)]."""
    good = [n for n, (_, lab, v) in enumerate(rows) if lab is not None and v and any(v) and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(rows[n][2]) for n in good), default=1)
    x = unit(np.array([list(np.float32(rows[n][2])) + [0.0] * (width - len(rows[n][2])) for n in good], dtype=float).reshape(len(good), width))
    label = np.array([rows[n][1] for n in good])
    link = (x @ x.T >= threshold) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    n_links, least = [0] * len(rows), [r[0] for r in rows]
    part = np.arange(len(good))
    for i, j in zip(*np.nonzero(link), strict=True):
        if part[i] != part[j]:
            part[part == part[j]] = part[i]
    for i, n in enumerate(good):
        n_links[n] = int(link[i].sum())
        ids = [rows[good[j]][0] for j in np.flatnonzero(part == part[i]) if rows[good[j]][0] is not None]
        least[n] = min(ids, default=None)
    return n_links, least


def clustered(n_hot=400, n_far=600, dims=16, seed=5):
    draw = np.random.default_rng(seed)
    hot = unit(draw.normal(size=(1, dims)) + 0.03 * draw.normal(size=(n_hot, dims)))
    wide = unit(hot[0] + 0.09 * draw.normal(size=(60, dims)))
    far = unit(draw.normal(size=(n_far, dims)))
    close = unit(far[:200] + 0.08 * draw.normal(size=(200, dims)))
    every = np.concatenate([hot, wide, far, close, hot[:50], far[:30]])
    label = [1] * (len(hot) + len(wide)) + [int(i % 2) for i in range(n_far)] + [int(i % 2) for i in range(200)] + [1] * 50 + [int(i % 2) for i in range(30)]
    return [(i + 1, lab, [float(x) for x in v]) for i, (lab, v) in enumerate(zip(label, every, strict=True))]


def compared(spark, rows, **options):
    table = spark.createDataFrame([(i, lab, v, 1, 2, "x") for i, lab, v in rows], VECTORS)
    return {r.vec_id: r for r in vector_duplicates(table, **options).collect()}


@pytest.mark.parametrize("block", [64, 1024])
def test_vector_duplicates(spark, block):
    rows = clustered()
    n_links, least = links_by_force(rows, 0.93)
    got = compared(spark, rows, cell_rows=40, block=block, recall=1.0)
    assert len(got) == len(rows)
    found = sum(got[i].n_links for i, _, _ in rows)
    assert all(got[i].n_links <= n for (i, _, _), n in zip(rows, n_links, strict=True))  # none is made up
    assert found >= 0.99 * sum(n_links)
    right = sum(got[i].component_id == c for (i, _, _), c in zip(rows, least, strict=True))
    assert right >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_full_cells_hold_balls(spark, monkeypatch):
    """Members of a ball are counted by number; blocks of it never meet."""
    rows = clustered()
    made = []
    plain = vector_dedup._balls
    monkeypatch.setattr(vector_dedup, "_balls", lambda *a: made.append(plain(*a)) or made[-1])
    compared(spark, rows, cell_rows=40, block=64)
    assert made[0].groupBy("ball").count().agg(F.max("count")).first()[0] >= 300


def test_budget_meets_recall():
    draw = np.random.default_rng(11)
    x = unit(draw.normal(size=(6000, 32)))
    grid = fit_grid(x, np.zeros(6000), 500_000, 0.9, 0.95)
    assert len(grid.left) == 16
    row, cell = grid.visits(x[:50])
    for i in range(50):
        mine = cell[row == i]
        assert mine[0] == grid.home(x[i : i + 1])[0] and len(set(mine)) == len(mine)
        every = np.arange(len(grid.left) * len(grid.right))
        cost = grid.cost(np.repeat(x[i : i + 1], len(every), axis=0), every)
        assert set(mine) == set(every[cost <= grid.budget])
        assert (np.diff(cost[mine]) >= -1e-12).all()
    aside = draw.normal(size=x.shape)
    aside = unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    near = 0.9 * x + math.sqrt(1 - 0.81) * aside
    met = np.minimum(grid.cost(x, grid.home(near)), grid.cost(near, grid.home(x))) <= grid.budget
    assert met.mean() >= 0.93


def test_vector_duplicates_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(5, 1, v), (5, 1, v), (None, 1, v), (3, 1, [2.0, 4.0, 6.0, 8.0]), (4, 2, v), (6, None, v), (7, 1, None), (8, 1, []), (9, 1, [0.0] * 4), (10, 1, [float("nan")] * 4), (11, 1, [None, 1.0]), (12, 1, [1.0]), (13, 1, [5.0, 0.0, 0.0, 0.0]), (14, 1, [3e38] * 4), (None, None, None)]
    table = spark.createDataFrame([(i, lab, x, 1, 2, "x") for i, lab, x in rows], VECTORS)
    n_links, least = links_by_force(rows, 0.93)
    want = sorted(((i or -1), n, c or -1, i == c) for (i, _, _), n, c in zip(rows, n_links, least, strict=True))
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in vector_duplicates(table).collect()) == want
    assert vector_duplicates(table.limit(0)).count() == 0
    assert {r.n_links for r in vector_duplicates(table.filter("label IS NULL")).collect()} == {0}


def test_vector_query_on_its_table(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n_links, least = links_by_force(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op13_vector_dedup(spark, SF).collect()}
    assert got == {i: (n, c) for (i, _, _), n, c in zip(rows, n_links, least, strict=True)}
