"""Slots, query plans and budgeted queries: known claims and odd rows."""

from pyspark.sql import functions as F

from plumbline.functions import design

SCHEMA = "claim_id long, claim string, parts array<string>, entities array<string>, told array<string>"


def test_slots(spark):
    claims = [(1, "Daily walking reduces the risk of heart attack or stroke in older adults"), (2, 'The "Low-Fat diet" is better than the keto diet for men'), (3, None), (4, "  ")]
    got = {r.claim_id: r.s for r in spark.createDataFrame(claims, "claim_id long, claim string").select("claim_id", design.slots(F.col("claim")).alias("s")).collect()}
    assert got[1].topic[0] == "heart attack" and got[1].population == ["adults", "adult", "older adults"]
    assert "the risk of heart attack" in got[1].outcome
    assert got[2].topic[0] == "low-fat diet" and "keto diet for men" in " ".join(got[2].comparator)
    assert {x.key: x["values"] for x in got[2].synonyms}["low-fat diet"][:2] == ["low-fat diets", "low fat diet"]
    assert got[3].anchors == got[4].anchors == []


def test_plans(spark):
    claims = spark.createDataFrame([(1, "Zinc lozenges reduce the common cold in children"), (2, "No two tongue prints are identical"), (3, None)], "claim_id long, claim string")
    drift = spark.createDataFrame([("EFFICACY", "pdf", 3), ("EFFICACY", "manual", 0), ("MYTH", "policy", 2)], "claim_type string, token string, n long")
    got = {r.claim_id: r for r in design.query_plans(claims, drift).collect()}
    assert got[1].claim_type == "EFFICACY" and "pdf" in got[1].negatives and "manual" not in got[1].negatives and "policy" not in got[1].negatives
    assert got[1].negatives == sorted(got[1].negatives)
    for r in got.values():
        assert 6 <= len(r.plan) <= 8 and len({p.q.lower() for p in r.plan}) == len(r.plan)
        assert all(p.q.endswith(" -" + " -".join(r.negatives[:8])) for p in r.plan)
    assert got[1].plan[0].weight == 1.0 and got[1].plan[0].goal == "primary evidence (quoted)" and got[1].plan[0].q.startswith('"')
    assert any(p.q.startswith("site:pubmed") for p in got[2].plan)
    assert {r.claim_id: r.negatives for r in design.query_plans(claims).collect()}[1] == sorted((*design.NEGATIVE, *design.NEGATIVE_OF["EFFICACY"]))


def test_search_queries(spark):
    many = [f"{x} prevents disease{i} in adults" for i, x in enumerate(("Zinc", "Iron", "Copper", "Selenium", "Iodine", "Calcium", "Magnesium"))]
    rows = [(1, ". ".join(many), many, None, None), (2, "Zinc shortens colds", ["Zinc shortens colds"], ["zinc", None, "common cold"], ["zinc colds trial results", "nothing known here", None]), (3, "", [], None, None), (4, None, None, None, None), (5, "the of and", ["the of and", None, " "], [], [])]
    got = {r.claim_id: r for r in design.search_queries(spark.createDataFrame(rows, SCHEMA), 6, "told").collect()}
    assert len(got) == 5
    assert len(got[1].required) == 7 and got[1].queries == got[1].required[:6]
    assert got[2].queries[0] == got[2].required[0] and len(got[2].queries) == len(set(got[2].queries)) <= 6
    wide = {r.claim_id: r.queries for r in design.search_queries(spark.createDataFrame(rows, SCHEMA), 40, "told").collect()}
    assert "zinc colds trial results" in wide[2] and "nothing known here" not in wide[2] and any(q.startswith("site:") for q in wide[2])
    assert got[3].queries == got[4].queries == got[5].queries == []
    assert design.search_queries(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fallbacks(spark):
    row = spark.createDataFrame([("Zinc Helps", ["iron"])], "t string, f array<string>").select(design.fallback_queries(F.col("t"), F.col("f")).alias("q"), design.fallback_queries(F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("n")).first()
    assert row.q[0] == "zinc helps medical evidence" and row.q[-1] == "iron scientific facts" and len(row.q) == 7 and len(row.n) == 4
