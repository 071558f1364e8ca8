"""Anchors, answers, replies and rounds on cases worked out by hand."""

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from plumbline.functions import anchors, answers
from plumbline.operators import lists, rounds


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def _texts(*items):
    return F.array(*[F.lit(i).cast("string") for i in items])


def test_rule_anchors(spark):
    part = "Zinc reduces the duration of the common cold"
    assert _one(spark, anchors.rule_anchors(F.lit(part), _texts("common cold", "iron", None))) == ["common cold", "zinc reduces", "reduces duration", "duration"]
    assert _one(spark, anchors.rule_anchors(F.lit("Zinc works"), F.lit(None).cast("array<string>"))) == ["zinc", "zinc"]
    assert _one(spark, anchors.rule_anchors(F.lit(None).cast("string"), _texts("zinc"))) == []
    assert _one(spark, anchors.normalized(F.lit("The (B12) study!"))) == "b12" and _one(spark, anchors.normalized(F.lit("an mg"))) == ""


def test_words_of_a_verdict(spark):
    segments = F.array(*[F.struct(F.lit(s).cast("string").alias("status"), F.lit(f).cast("string").alias("supporting_fact")) for s, f in [("valid", " zinc helps "), ("Invalid", ""), (None, "x")]])
    assert _one(spark, answers.key_findings(segments)) == ["VALID: zinc helps"]
    assert _one(spark, answers.rationale(F.lit("MISLEADING"), segments)) == answers.BOTH_WAYS
    assert _one(spark, answers.rationale(F.lit(None).cast("string"), F.lit(None).cast("array<struct<status:string,supporting_fact:string>>"))) == answers.WITH_CAVEATS
    assert _one(spark, answers.shown_verdict(F.lit(" false "), F.lit("maybe"))) == "FALSE"


def test_replies(spark):
    got = _one(spark, answers.results_of(F.lit('note {"triples": [{"subject": "a"},],} end')))
    assert [(r["index"], r.triples[0].subject) for r in got] == [(0, "a")]
    assert _one(spark, answers.results_of(F.lit(None).cast("string"))) is None
    assert _one(spark, answers.queries_of(F.lit('{"queries": ["A a b", 1, "a b", "c"]}'), 2)) == ["a b"]


def test_samples_reach_into_lists(spark):
    kind = StructType([StructField("a", ArrayType(ArrayType(LongType())))])
    row = spark.createDataFrame([(([[1, 2, 3], [4], [5]],),)], StructType([StructField("s", kind)])).select(answers.sampled(F.col("s"), kind, 2).alias("x")).first().x
    assert row.a == [[1, 2], [4]]


def test_results_by_index(spark):
    items = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "batch string, item int")
    results = spark.createDataFrame([("a", 1, "x"), ("a", 2, "lost"), ("b", 0, "y")], "batch string, index int, name string")
    assert sorted((r.item, r.name) for r in lists.by_index(results, items, "batch", "item").collect()) == [(1, "y"), (5, "x")]
    assert lists.by_index(results, items, "batch", "item", every_item=True).filter("name IS NULL").first().item == 3


EVIDENCE = "claim_id int, evidence_id int, semantic_score double, source_url string, statement string, published_at timestamp, stance string"


def test_trust_rounds_stop_for_their_reasons(spark):
    claims = spark.createDataFrame([(1,), (2,), (3,), (4,)], "claim_id int")

    def retrieve(still, number):
        rows = [(1, 1, 1.0, "https://a.org/1", "s", None, "entails"), (2, 1, 0.2, None, "t", None, "neutral"), (4, number, 0.1 * number, None, f"u{number}", None, "neutral")]
        return still.sparkSession.createDataFrame(rows, EVIDENCE).join(still, "claim_id", "left_semi")

    states = rounds.trust_rounds(claims, retrieve, lambda going, number: going.filter("claim_id <> 3"), F.lit("2024-01-01").cast("timestamp"), F.lit(1.0))
    last = {r.claim_id: (r.round, r.stop_reason) for r in states.orderBy("round").collect()}
    assert last == {1: (1, rounds.MET), 2: (2, rounds.NO_GAIN), 3: (1, rounds.NOTHING_NEW), 4: (2, rounds.NO_GAIN)}
    assert states.filter("claim_id = 3").first().trust_post == 0.0 and states.filter("claim_id = 1").count() == 1
    assert rounds.trust_rounds(claims.limit(0), retrieve, lambda going, number: going, F.lit("2024-01-01").cast("timestamp"), F.lit(1.0)).count() == 0


def test_candidates_without_anchors_and_empty_tables(spark):
    claims = spark.createDataFrame([(1, "Zinc helps", None), (2, "Zinc helps", ["zinc"])], "claim_id int, claim string, anchors array<string>")
    sem = "claim_id int, seq int, statement string, source_url string, entities array<string>, context_entities array<string>, claim_context_match boolean, score double"
    semantic = spark.createDataFrame([(1, 1, "tea", None, None, None, None, 0.1), (2, 2, "tea", None, None, None, None, 0.1), (2, 3, None, None, ["zinc"], None, None, None), (2, 4, "tea", None, None, None, True, 0.0), (2, 5, "Tea ", None, None, None, None, 0.9)], sem)
    lexical = spark.createDataFrame([], sem + ", bm25 double")
    graph = spark.createDataFrame([(2, 6, "zinc", "may_help", None, " ", "https://a.org", None, 0.97, None, None, None), (2, 7, "tea", "x", "y", None, None, 0.1, None, None, None, 0.4)], "claim_id int, seq int, subject string, relation string, object string, statement string, source_url string, kg_score_raw double, kg_score double, confidence double, path_quality_score double, score double")
    got = {r.seq: (r.statement, r.score) for r in rounds.retrieval_phase(claims, semantic, lexical, graph).collect()}
    assert got == {1: ("tea", 0.1), 3: (None, None), 5: ("Tea ", 0.9), 6: ("zinc may help", 1.0)}
    assert rounds.retrieval_phase(claims.limit(0), semantic, lexical, graph).count() == 0


def test_reinforced_claims_stop_for_their_reasons(spark):
    ranked = spark.createDataFrame([(1, 0.9), (1, 0.1), (2, 0.2), (3, 0.3), (4, 0.5)], "claim_id int, final_score double")
    known = spark.createDataFrame([(2, "old")], "claim_id int, url string")
    urls = spark.createDataFrame([(1, "x", 1), (2, "old", 1), (3, "n1", 1), (3, "n1", 2), (4, "m1", 1), (4, "m2", 2)], "claim_id int, url string, r int")

    def rank(fresh, number):
        return fresh.select("claim_id", (F.col("claim_id") * 0.15).alias("final_score"))

    rows, ends = rounds.reinforced(ranked, known, lambda weak, number: urls.filter(F.col("r") == number).join(weak.select("claim_id"), "claim_id", "left_semi"), rank, 0.64, rounds=2)
    assert {r.claim_id: (r.rounds, r.reason) for r in ends.collect()} == {1: (0, rounds.ENOUGH_NOW), 2: (0, rounds.FEW_URLS), 3: (1, rounds.FEW_URLS), 4: (1, rounds.ENOUGH_NOW)}
    assert sorted((r.claim_id, round(r.final_score, 2)) for r in rows.collect()) == [(1, 0.1), (1, 0.9), (2, 0.2), (3, 0.45), (4, 0.6)]
