"""Pair scores, the guard on rewritten claims, canonical claims and their queries: known cases and odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import canonical, pairs
from plumbline.functions.segments import segmented


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "Zinc shortens colds", "zinc shortens colds!"), (2, "Zinc shortens colds", "Zinc does not shorten colds"), (3, "Zinc", ""), (4, None, "x"), (5, "of the", "of the cold"), (6, "", None)]
    return spark.createDataFrame(rows, "id long, a string, b string")


def by(rows):
    return {r.id: r for r in rows.collect()}


def test_rule_scores(texts):
    got = by(texts.select("id", pairs.rule_scores(F.col("a"), F.col("b")).alias("s")).select("id", "s.*"))
    sig = lambda x: 1 / (1 + math.exp(-x))
    e, c = sig(1.6 + 1.2 - 1.4), sig(1.4 - 1.3)
    n = max(0, 1 - max(e, c))
    assert got[1].entail == pytest.approx(e / (e + c + n)) and got[1].contradict == pytest.approx(c / (e + c + n))
    assert got[2].contradict > got[2].entail
    for i, want in ((3, (0, 0, 1)), (4, (0, 0, 1)), (6, (0, 0, 1)), (5, (0.25, 0.25, 0.5))):
        assert (got[i].entail, got[i].contradict, got[i].neutral) == want


@pytest.mark.parametrize(
    ("raw", "labels", "want"),
    [
        (None, pairs.LABELS, None),
        ([], pairs.LABELS, None),
        ([0.0], pairs.LABELS, (0.5, 0.5, 0.0)),
        ([0.0, 0.0], pairs.LABELS, (1 / 3, 1 / 3, 1 / 3)),
        ([9.0, 0.0, 0.0], pairs.LABELS, (0, 1, 0)),
        ([9.0, 0.0, 0.0], ("entailment", "neutral", "contradiction"), (1, 0, 0)),
        ([0.0, 0.0, 9.0], ("x", "y", "z"), (1, 0, 0)),
        ([900.0, -900.0, 0.0], ("REFUTES", "neutral", "entails"), (0, 1, 0)),
    ],
)
def test_decoded(spark, raw, labels, want):
    row = spark.createDataFrame([(raw,)], "raw array<double>").select(pairs.decoded(F.col("raw"), labels).alias("m")).first().m
    assert (row is None) == (want is None)
    if want:
        assert (row.entail, row.contradict, row.neutral) == pytest.approx(want, abs=1e-3)


def test_models_are_loaded_once_a_task_and_may_fail(texts):
    def load():
        calls = []

        def model(asked):
            calls.append(len(asked))
            if any("not" in b for _, b in asked):
                raise ValueError("cannot say")
            return [[float(len(calls))] for _ in asked]

        return model

    one = texts.coalesce(1)
    got = by(pairs.with_model_outputs(one, load, "a", "b", batch=1))
    assert (got[1].raw, got[2].raw, got[3].raw, got[4].raw, got[5].raw) == ([1.0], None, None, None, [3.0])

    def broken():
        raise OSError("no such model")

    assert all(r.raw is None for r in pairs.with_model_outputs(one, broken, "a", "b").collect())
    both = pairs.with_model_outputs(one, broken, "a", "b").select("id", pairs.blended(pairs.decoded(F.col("raw")), pairs.rule_scores(F.col("a"), F.col("b"))).alias("k"), pairs.rule_scores(F.col("a"), F.col("b")).alias("s"))
    assert all(r.k == r.s for r in both.collect())
    assert pairs.with_model_outputs(one.limit(0), load, "a", "b").count() == 0


def test_guard(texts):
    got = by(texts.select("id", canonical.guarded(F.col("a"), F.col("b"), F.lit(0.9)).alias("g")).select("id", "g.*"))
    assert got[1].canonical_accepted and got[1].text == "zinc shortens colds!" and got[1].worth == 0.9
    assert not got[2].canonical_accepted and got[2].canonical_rejected_reason.startswith("drift_guard_failed:min_entail=") and got[2].text == "Zinc shortens colds" and got[2].worth == pytest.approx(0.72)
    assert got[3].canonical_rejected_reason == "empty_canonical_segment" and got[3].text == "Zinc"
    assert got[4].canonical_rejected_reason == "empty_original_segment" == got[6].canonical_rejected_reason


def claims(spark, rows):
    return segmented(spark.createDataFrame(list(enumerate(rows)), "claim_id long, claim string"))


def test_canonical_claims(spark):
    parts = claims(spark, ["Vaccines do not cause autism or the flu.", "Moderate sun.", None, "Handwashing is recommended by the WHO guidelines"])
    rows = canonical.canonicalized(parts).orderBy("claim_id", "part").collect()
    assert [(r.claim_id, r.original_text, r.canonical_accepted) for r in rows[:2]] == [(0, "Vaccines do not cause autism", True), (0, "Vaccines do not cause the flu", True)]
    assert rows[2].canonical_rejected_reason and not rows[2].canonical_accepted
    assert rows[3].predicate_family == "recommendation"
    off = canonical.canonicalized(parts, guard=False).filter("claim_id = 1").first()
    assert off.canonical_rejected_reason == "canonical_parse_incomplete"

    def rewrite(asked):
        return asked.select("claim_id", "part", F.when(F.col("original_text") == "Moderate sun", "moderate sun").otherwise("Bleach cures everything").alias("rewritten"))

    told = {r.original_text: r for r in canonical.canonicalized(parts, rewrite).collect()}
    assert told["Moderate sun"].normalized_text == "moderate sun" and not told["Moderate sun"].canonical_accepted
    assert canonical.canonicalized(parts.limit(0)).count() == 0


def test_queries_of_parts(spark):
    parts = canonical.canonicalized(claims(spark, ["Vaccines do not cause autism or the flu.", "Handwashing is recommended by the WHO guidelines", ". , ;"]))
    asked = canonical.part_queries(parts)
    first = [(r.query, r.track, r.facet) for r in asked.filter("claim_id = 0 AND part = 1").orderBy("place").collect()]
    assert first[:3] == [("Vaccines do not cause autism", "original", "support"), ("Vaccines do not cause autism evidence", "original", "support"), ("Vaccines do not cause autism systematic review", "original", "support")]
    assert len(first) == 8 and first[3][0].startswith("no evidence ")
    advice = [r.query for r in asked.filter("claim_id = 1").orderBy("place").collect()]
    assert advice[0] == "WHO recommends Handwashing" and len(advice) == 8 and "WHO does not recommend Handwashing" in advice
    assert asked.filter("claim_id = 2").count() == 0
    assert canonical.part_queries(parts, most=2).groupBy("claim_id", "part").count().agg(F.max("count")).first()[0] == 2
    merged = {r.claim_id: r for r in canonical.claim_queries(asked).collect()}
    assert merged[0].merged == merged[0].original + [q for q in merged[0].canonical if q not in merged[0].original] and len(set(merged[0].merged)) == len(merged[0].merged)
    kept = {r.claim_id: r for r in canonical.tracks(parts).collect()}
    assert kept[0].original == ["Vaccines do not cause autism", "Vaccines do not cause the flu"]


def test_model_entities(texts):
    def load():
        def model(asked):
            if any("of the" in t for t in asked):
                raise ValueError("no")
            return [[" Zinc ", "zinc", "study", 7, t.split()[-1]] for t in asked]

        return model

    got = by(pairs.with_model_entities(texts.coalesce(1), load, "b", batch=1))
    assert got[1].entities == ["zinc", "colds!"] and got[2].entities == ["zinc", "colds"]
    assert got[3].entities == got[6].entities == [] and got[5].entities == []

    def broken():
        raise OSError("no such model")

    assert all(r.entities == [] for r in pairs.with_model_entities(texts, broken, "b").collect())
