"""Keys that very many rows have."""

import math

import pytest
from test_registry import SF

from plumbline.operators import dedup
from plumbline.plans import registry


def test_confident_facts_fold_before_the_shuffle(spark):
    plan = registry.queries()["d8_facts_by_confidence"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "min_by" in plan


@pytest.mark.parametrize("most", [10_000, 0])
def test_confident_rows_are_those_of_the_fold(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "BROADCAST_GROUPS", most)
    scores = (None, 0.0, 0.3, 0.5, 0.7, 0.7)
    given = [(k, i, scores[(k or 9) * (i + 3) * 7919 % 61 % (3 if (k or 9) % 2 else 6)]) for k in (None, *range(1, 40)) for i in range((k or 9) % 7 + 1)]
    want = {}
    for k, i, x in given:
        if k not in want or (want[k][1] or 0) < (0.5 if x is None else x):
            want[k] = (i, x)
    got = dedup.keep_confident(spark.createDataFrame(given, "k int, i int, c double"), ["k"], "c", "i").collect()
    assert len(got) == len(want) == 40
    assert all(want[r.k] == (r.i, r.c) for r in got)


def test_rows_without_an_order_or_number(spark):
    given = [("a", 1, math.nan), ("a", 2, 0.9), ("b", None, 0.2)]
    got = dedup.keep_confident(spark.createDataFrame(given, "k string, i int, c double"), ["k"], "c", "i").collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 1), ("b", None)]
