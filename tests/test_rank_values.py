"""The rank reads texts once for each pair of distinct claims and statements, and row by row where these are many: the same rows either way."""

import pytest
from pyspark.sql import functions as F
from test_registry import SF

from plumbline import session
from plumbline.functions import domains
from plumbline.plans import registry


def plan_of(spark, name):
    """The whole plan: long lists of columns are not cut in it."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


RANKS = ("t1_f14_f15_f53_hybrid_rank", "f2_t5_t8_t9_t10_graded")


@pytest.mark.parametrize("name", RANKS)
def test_texts_are_read_once(spark, name):
    assert "RLIKE" not in plan_of(spark, name)


def test_many_texts_are_read_row_by_row(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, registry.queries()[RANKS[0]](spark, SF).collect()), key=repr)
    few = rows()
    monkeypatch.setattr(session, "BROADCAST_VALUES", 0)
    assert "RLIKE" in plan_of(spark, RANKS[0]) and rows() == few and len(few) > 1000


def test_trust_by_last_labels(spark):
    bare = ["", "int", "who.int", "a.b.who.int", "xwho.int", "who.int.", ".who.int", "pmc.ncbi.nlm.nih.gov", "x.pmc.ncbi.nlm.nih.gov", "cks.nice.org.uk", "org.uk", "gov.uk", "who.int.example", "..", "fda.gov"]
    got = spark.createDataFrame([(b,) for b in bare], "u string").select("u", domains.is_trusted(F.col("u")).alias("t")).collect()
    plain = lambda d: any(d == r or d.endswith("." + r) for r in domains.TRUSTED_ROOTS)
    assert [r.t for r in got] == [plain(b) for b in bare] and not spark.range(1).select(domains.is_trusted(F.lit(None).cast("string"))).first()[0]
