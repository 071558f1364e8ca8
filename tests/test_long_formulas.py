"""Long formulas of the rank stay in methods that the JVM compiles, and its phase reads texts once and deals rows by claim once."""

import re

import pytest
from test_registry import SF
from test_rank_values import plan_of

from plumbline.plans import registry

#: Bytes of a method beyond which the JVM only interprets it.
MOST = 8000


@pytest.mark.parametrize("name", ["t1_f14_f15_f53_hybrid_rank", "f2_t5_t8_t9_t10_graded", "t3_b7_j18_j19_rank_phase"])
def test_methods_are_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = registry.queries()[name](spark, SF)
        told = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", told)]
    assert len(sizes) > 5 and max(sizes) <= MOST


def test_phase_reads_texts_once(spark):
    assert "RLIKE" not in plan_of(spark, "t3_b7_j18_j19_rank_phase")


def test_phase_deals_rows_by_claim_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()["t3_b7_j18_j19_rank_phase"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # evidence once, and the claims for each of two joins
    assert plan.count("Exchange hashpartitioning") <= 3
