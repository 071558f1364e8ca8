"""What queries deal anew."""

import pytest
from test_registry import SF

from plumbline.plans import registry


def plan(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution()


def test_merged_candidates_are_dealt_once(spark):
    assert plan(spark, "j8_w1_u23_merge_candidates").executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("column", ["entities", "published_at", "statement"])
def test_first_evidence_leaves_other_columns(spark, column):
    (aggregate,) = [x for x in plan(spark, "d15_first_evidence").optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert "min_by" in aggregate and column not in aggregate
