"""Columns that are worked out once for each distinct value."""

import pytest
from pyspark.sql import functions as F
from test_registry import SF

from plumbline import session
from plumbline.plans import registry


@pytest.mark.parametrize("most", [100_000, 0])
def test_by_value(spark, monkeypatch, most):
    monkeypatch.setattr(session, "BROADCAST_VALUES", most)
    given = [(1, "a", ["x", None]), (2, None, ["x"]), (3, "a", ["x", None]), (4, "", None), (5, None, None), (6, None, None), (7, "a", [])]
    df = spark.createDataFrame(given, "id int, t string, e array<string>")
    seen = []

    def made(values):
        seen.append(values.count())
        return values.withColumn("n", F.coalesce(F.length("t"), F.lit(-1)) + F.coalesce(F.size("e"), F.lit(-10)))

    got = sorted(tuple(r) for r in session.by_value(df, ["t", "e"], made).select("id", "t", "e", "n").collect())
    assert seen == [5]
    assert [r[:3] for r in got] == given
    assert [r[3] for r in got] == [3, 0, 3, -10, -11, -11, 1]


#: Queries, and what of their work on texts the rows themselves must not do.
ONCE = {"u69_u70_grounded_statements": "array_max", "u90_u91_query_plans": "regexp", "f52_u99_u100_u101_u104_u109_part_queries": "regexp", "u45_part_queries": "regexp", "u45_u46_dual_tracks": "regexp", "u61_u62_u63_u64_u65_j15_enriched_facts": "regexp", "u48_u49_evidence_strength": "regexp", "a5_coverage": "regexp", "u75_u76_j14_resolved_triples": "regexp"}


@pytest.mark.parametrize("name", sorted(ONCE))
def test_texts_are_read_once(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and ONCE[name] not in plan
