"""Cases of the ranking, coverage and policy operators whose outcomes are known."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import policy, scoring
from plumbline.operators import coverage, dedup, evidence, extraction, hybrid, ingest, logic, trust, verdict

CANDIDATE = "claim_id long, side string, seq long, statement string, score double, entities array<string>, source_url string, published_at timestamp, credibility double, candidate_type string, is_backfill boolean"


def ranked(spark, rows, claim="", entities=()):
    """rows: (side, statement, score, entities, url, credibility)."""
    table = [(1, s, i, t, x, list(e), u, None, c, None, None) for i, (s, t, x, e, u, c) in enumerate(rows)]
    claims = spark.createDataFrame([(1, claim, list(entities))], "claim_id long, claim string, entities array<string>")
    out = hybrid.hybrid_rank(spark.createDataFrame(table, CANDIDATE), claims, F.lit("2025-01-01").cast("timestamp"))
    return sorted(out.collect(), key=lambda r: r["rank"])


def test_graph_candidates_alone_are_ranked(spark):
    got = ranked(spark, [("kg", "weak", 0.3, ["a"], None, None), ("kg", "strong", 0.9, ["b"], None, None), ("kg", "fair", 0.6, ["c"], None, None)])
    assert [r["statement"] for r in got] == ["strong", "fair", "weak"] and all(0 < r["final_score"] <= 1 for r in got)
    one = ranked(spark, [("kg", "a faint relation", 0.2, ["x"], None, None)])
    assert len(one) == 1 and one[0]["candidate_type"] == "KG"


def test_both_sides_of_a_statement_are_one_row(spark):
    got = ranked(spark, [("sem", "shared words", 0.8, ["Left"], None, None), ("kg", " shared words ", 0.7, ["right"], None, None), ("sem", "shared words", 0.4, [], "https://cdc.gov/x", None)])
    assert len(got) == 2
    both = next(r for r in got if r["source_url"] is None)
    assert (both["sem_raw"], both["kg_raw"], both["candidate_type"]) == (0.8, 0.7, "KG")
    assert {e.lower() for e in both["entities"]} == {"left", "right"}


def test_authority_beats_the_unknown(spark):
    got = ranked(spark, [("sem", "from a blog", 0.6, ["t"], "https://blog.example/p", 0.3), ("sem", "from the authority", 0.6, ["t"], "https://who.int/e", 0.95)])
    assert got[0]["statement"] == "from the authority" and got[0]["final_score"] > got[1]["final_score"] + 0.2


def test_a_dropped_graph_candidate_comes_back(spark):
    rows = [("sem", "Sleep is improved by melatonin at night", 0.92, ["sleep"], "https://cdc.gov/s", None), ("kg", "An unrelated pathway regulates hormones", 0.7, ["hormone"], "https://nih.gov/s", None)]
    got = ranked(spark, rows, "melatonin helps with sleep", ["sleep"])
    assert any(r["candidate_type"] == "KG" for r in got)


def test_page_furniture_goes_but_scales(spark):
    got = ranked(spark, [("sem", "Please enable JavaScript here", 1.0, [], None, None), ("sem", "good", 0.5, [], None, None), ("sem", "poor", 0.2, [], None, None)])
    assert [r["statement"] for r in got] == ["good", "poor"] and got[0]["sem"] == pytest.approx(0.375)


EVIDENCE = "claim_id long, evidence_id long, statement string, semantic_score double, trust double, stance string, candidate_type string, source_url string, on_topic boolean, admissible boolean"


def details(spark, parts, rows):
    p = spark.createDataFrame([(1, i, s, None) for i, s in enumerate(parts, 1)], "claim_id long, part int, subclaim string, anchors array<string>")
    e = spark.createDataFrame([(1, i, t, x, y, s, None, u, None, None) for i, (t, x, y, s, u) in enumerate(rows)], EVIDENCE)
    return sorted(coverage.covered(p, e).collect(), key=lambda r: r["part"]), coverage.adaptive_trust(p, e).first()


def test_a_shared_object_word_needs_a_high_score(spark):
    parts = ["Vaccines do not cause autism", "Vaccines do not cause the flu"]
    got, _ = details(spark, parts, [("Vaccines are not associated with autism.", 0.95, 0.9, "entails", "https://nih.gov/1")])
    assert [r["status"] for r in got] == ["STRONGLY_VALID", "STRONGLY_VALID"] and [r["anchors_matched"] for r in got] == [2, 1]
    got, whole = details(spark, parts, [("Vaccines are not associated with autism.", 0.75, 0.7, "entails", "https://nih.gov/1")])
    assert [r["status"] for r in got] == ["STRONGLY_VALID", "PARTIALLY_VALID"] and whole["coverage"] == 0.75


def test_contradiction_covers_nothing(spark):
    got, whole = details(spark, ["Vaccines do not cause autism"], [("Some studies say vaccines cause autism.", 0.92, 0.9, "contradicts", "https://a.example")])
    assert (got[0]["status"], got[0]["contradicted"], whole["coverage"], whole["enough"]) == ("INVALID", True, 0.0, False)
    none, empty = details(spark, ["Something else"], [])
    assert (none[0]["status"], none[0]["evidence_id"], empty["trust_post"], empty["state"]) == ("UNKNOWN", -1, 0.0, "evidence_insufficiency")


def test_negated_evidence_for_a_negated_part(spark):
    got, _ = details(spark, ["Antibiotics do not work against viruses"], [("Antibiotics do not treat viral infections.", 0.95, 0.9, "neutral", "https://cdc.gov/a")])
    assert got[0]["status"] in ("STRONGLY_VALID", "PARTIALLY_VALID")


STRENGTH = "claim_id long, strength struct<support:double,hedge:double,rarity:double,quality:double,stance:string,negation_anchor:double>"


def override(spark, claim, strengths, statuses, verdict_, truth, confidence, diversity, agreement, count):
    c = spark.createDataFrame([(1, claim, verdict_, truth, confidence, diversity, agreement, count, 0.0)], "claim_id long, claim string, verdict string, truthfulness double, confidence double, diversity double, agreement double, evidence_count long, kg_hint double")
    return logic.overrides(c, spark.createDataFrame([(1, s) for s in strengths], STRENGTH), spark.createDataFrame([(1, s) for s in statuses], "claim_id long, status string")).first()


def test_overrides(spark):
    refutes = [(x, 0.05, 0.02, 0.9, "REFUTES", 0.0) for x in (0.85, 0.8, 0.79)]
    got = override(spark, "This cure always prevents all disease, and it definitely cures every patient", [(0.3, 0.6, 0.5, 0.75, "SUPPORTS", 0.0), *refutes], ["INVALID", "PARTIALLY_INVALID", "UNKNOWN"], "TRUE", 76.0, 0.9, 0.7, 0.8, 4)
    assert (got["override_fired"], got["verdict"], got["truthfulness_cap"]) == ("CONTRADICTION_DOMINANCE", "FALSE", 20.0)
    got = override(spark, "This always cures disease.", [(0.9, 0.0, 0.0, 0.95, "SUPPORTS", 0.0)], ["VALID"], "TRUE", 95.0, 0.95, 0.0, 1.0, 1)
    assert got["confidence_cap"] <= 0.75 and got["cap_fired"]
    got = override(spark, "If a patient improves diet and exercise, the dose can sometimes be reduced.", [(0.7, 0.1, 0.05, 0.9, "SUPPORTS", 0.0)], ["VALID", "UNKNOWN"], "UNVERIFIABLE", 42.0, 0.55, 0.5, 0.85, 3)
    assert (got["override_fired"], got["verdict"], got["truthfulness_cap"]) == ("MULTIHOP_RELAXATION", "PARTIALLY_TRUE", 45.0)


def test_class_calibration(spark):
    def run(t, f, u, cov, adm, sup, con, **more):
        out = verdict.calibrated_classes(*[F.lit(x) for x in (t, f, u, cov, adm, sup, con)], **more)
        return spark.range(1).select(*[c.alias(str(i)) for i, c in enumerate(out)]).first()

    a = run(0.07, 0.08, 0.85, 0.35, 1.0, 0.18, 0.21)
    assert abs(sum(a) - 1) < 1e-9 and a[2] < 0.88
    b = run(0.50, 0.15, 0.35, 0.60, 0.80, 0.55, 0.10)
    assert b[0] > b[1] and b[0] > b[2]
    assert run(0.40, 0.30, 0.30, 0.10, 0.20, 0.05, 0.05)[2] >= 0.30
    assert run(0.0, 0.0, 0.0, 0.5, 0.5, 0.5, 0.5)[2] == 1.0
    warm = run(0.8, 0.1, 0.1, 0.60, 0.80, 0.5, 0.5, temperature={"true": 4.0})
    assert warm[0] < run(0.8, 0.1, 0.1, 0.60, 0.80, 0.5, 0.5)[0]


def test_confidence_artifacts(spark):
    def mapped(x, artifact):
        return spark.range(1).select(verdict.mapped_confidence(F.lit(x), artifact).alias("y")).first()["y"]

    assert mapped(0.5, {"mode": "linear", "slope": 0.5, "intercept": 0.1}) == pytest.approx(0.35)
    knots = {"mode": "piecewise", "knots": [{"x": 0.2, "y": 0.1}, {"x": 0.6, "y": 0.5}, {"x": 0.9, "y": 0.8}]}
    assert [mapped(x, knots) for x in (0.1, 0.6, 0.95)] == [0.1, 0.5, 0.8]
    assert mapped(0.4, {"reliability_bins": [{"min": 0.0, "max": 0.3, "calibrated": 0.2}, {"min": 0.3, "max": 0.5, "calibrated": 0.44}]}) == 0.44
    figures = [F.lit(x) for x in (0.5, 0.8, 0.9, 0.5, 0.0, 1.0, 0.7)]
    plain, deep = (spark.range(1).select(verdict.calibrated_confidence(*figures, quality=F.lit(0.3), depth=F.lit(x)).alias("y")).first()["y"] for x in (0.1, 0.9))
    assert deep == pytest.approx(0.92 * plain)


def test_count_gate(spark):
    claims = spark.createDataFrame([(1, "Adults have 206 bones.", ["bones", "skeleton"]), (2, "Vaccines help", ["vaccines"])], "claim_id long, claim string, entities array<string>")
    rows = [(1, "sem", "Marrow is inside bones", "definition"), (1, "sem", "The skeleton has 206 bones", "count"), (1, "kg", "skeleton has 206 bones", None), (1, "kg", "vaccines prevent disease", None), (2, "kg", "no number here", None)]
    got = logic.count_gate(spark.createDataFrame(rows, "claim_id long, side string, statement string, fact_type string"), claims).collect()
    assert sorted(r["statement"] for r in got) == ["The skeleton has 206 bones", "no number here", "skeleton has 206 bones"]


def test_triples_from_denying_statements(spark):
    schema = "subject string, relation string, object string, stance string, statement string"

    def usable(relation, statement, stance="SUPPORTS", **options):
        return spark.createDataFrame([("vaccines", relation, "autism", stance, statement)], schema).filter(~ingest.unusable_triple(**options)).count() == 1

    denial = "Studies show vaccines do not cause autism."
    assert not usable("causes", denial) and not usable("contributes to", denial) and not usable("lead_to", denial)
    assert usable("prevents", denial) and usable("causes", "Vaccines cause autism") and not usable("causes", "Vaccines cause autism", "NEUTRAL")
    assert not usable("does_not_cause", denial) and usable("does_not_cause", denial, as_written=False)
    assert ingest.ingest_counts(spark.createDataFrame([("a", "causes", "b", "neutral", ""), ("a", "causes", "b", "refutes", "")], schema)).first().asDict() == {"attempted": 2, "succeeded": 1, "failed": 1}


def test_evidence_without_url_is_known_by_its_words(spark):
    schema = "claim_id long, evidence_id long, statement string, semantic_score double, source_url string, published_at timestamp, stance string"
    rows = [(1, 1, "Test words", 0.8, "", None, "entails"), (1, 2, "  TEST WORDS ", 0.7, None, None, "entails"), (1, 3, "other words", 0.6, None, None, "entails"), (1, 4, "x", 0.5, "http://www.who.int:443/p/", None, "neutral"), (1, 5, "y", 0.4, "https://who.int/p", None, "neutral")]
    trusted = evidence.with_trust(spark.createDataFrame(rows, schema), F.lit("2025-01-01").cast("timestamp"), F.lit(0.5))
    got = evidence.trust_ranked(trusted).orderBy("rank").collect()
    assert [r["evidence_id"] for r in got] == [1, 3, 4] and got[2]["key"] == "https://who.int/p"


def test_trust_interval_by_force(spark):
    rows = [(c, r, 0.9 - 0.07 * r - 0.01 * c, f"k{(r * 7 + c) % 11}") for c in range(3) for r in range(1, 2 + 3 * c)]
    got = {r["claim_id"]: (r["ci_low"], r["ci_high"]) for r in trust.trust_interval(spark.createDataFrame(rows, "claim_id long, rank int, trust double, key string")).collect()}
    for c in range(3):
        own = [r for r in rows if r[0] == c]
        post = lambda xs: sum(x * x for x in xs) / sum(xs)
        want = (post([r[2] for r in own]),) * 2
        if len(own) > 1:
            rng = random.Random(int(hashlib.md5("".join(sorted(r[3] for r in own)).encode()).hexdigest(), 16) % 2**32)
            draws = sorted(post([rng.choice(own)[2] for _ in own]) for _ in range(200))
            want = draws[5], draws[195]
        assert got[c] == pytest.approx(want)


def test_facts_without_confidence(spark):
    def left(*confidences):
        rows = [("k", i, c) for i, c in enumerate(confidences)]
        return dedup.keep_confident(spark.createDataFrame(rows, "k string, i int, c double"), ["k"], "c", "i").first()["i"]

    def by_force(*confidences):
        held = 0
        for i, c in enumerate(confidences[1:], 1):
            if (confidences[held] or 0) < (0.5 if c is None else c):
                held = i
        return held

    for case in ((None, None), (0.4, None, 0.1), (0.5, None), (None, 0.0, 0.2, 0.2), (0.6, None, 0.7, 0.7), (0.1, 0.3, None), (0.2, None, 0.1, None, 0.3, 0.3)):
        assert left(*case) == by_force(*case), case


def test_grounded_statements(spark):
    cases = {"Zinc reduces the duration of colds.": True, "Does zinc reduce colds?": False, "Zinc may reduce colds.": False, "Many people believe zinc helps": False, "Short.": False}
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", extraction.grounded(F.col("x")).alias("g")).collect()
    assert {r["x"]: r["g"] for r in rows} == cases


def test_labels_and_bands(spark):
    row = spark.range(1).select(scoring.semantic_label(F.lit(0.75)).alias("a"), scoring.truth_band(F.lit(None).cast("double")).alias("b"), scoring.untrusted_band(F.lit(56.0)).alias("c"), policy.relevance_label(F.lit(None).cast("string")).alias("d")).first()
    assert tuple(row) == ("GOOD", "LIKELY_FALSE", "MOSTLY_TRUE", "NEUTRAL")


def test_best_sentence_by_force(spark):
    import re

    source = "Zinc lozenges shorten colds in adults. Smoking does not cause colds at all. *Zinc* and sugar were given to adults with colds. Nothing here."
    listed = [re.sub(r"[*_`#~]", "", s.strip()) for s in re.split(r"(?<=[.!?])\s+", source) if len(s.strip()) > 10]
    tokens = lambda x: list(dict.fromkeys(t for t in re.findall(r"\b[a-z][a-z0-9_-]{2,}\b", x.lower()) if t not in extraction.GROUND_STOP))

    def by_force(statement):
        own, best = tokens(statement), ("", 0.0)
        for s in listed:
            t = tokens(s)
            n = len(set(own) & set(t))
            if own and t and n:
                score = 0.75 * n / len(own) + 0.25 * n / len(t) + 0.2 * (own[0] in t) + 0.1 * (len(own) > 1 and own[1] in t)
                if score > best[1]:
                    best = (s, score)
        return best

    cases = ["Zinc shortens colds", "Smoking causes colds", "adults with colds", "", "unrelated words"]
    rows = spark.createDataFrame([(x, source) for x in cases], "x string, s string").select("x", extraction.best_sentence(F.col("x"), F.col("s")).alias("b"), extraction.grounded_statement(F.col("x"), F.col("s")).alias("g")).collect()
    for r in rows:
        sentence, score = by_force(r["x"])
        assert r["b"]["sentence"] == sentence and r["b"]["score"] == pytest.approx(score)
    got = {r["x"]: r["g"] for r in rows}
    assert got["Smoking causes colds"] == "Smoking does not cause colds at all." and got["unrelated words"] == "unrelated words"


def test_evidence_items(spark):
    rows = spark.createDataFrame([(1, "Vaccines do not cause autism", 0.4, None, None), (1, "Vaccines cause autism", None, "entails", 0.7), (2, None, None, None, None), (3, "x", 1.0, "neutral", None)], "claim_id long, fact string, score double, stance string, final_score double")
    claims = spark.createDataFrame([(1, "Vaccines cause autism"), (2, None)], "claim_id long, claim string")
    got = evidence.evidence_items(rows, claims).orderBy("claim_id", "statement").collect()
    assert [(r.claim_id, r.stance, r.semantic_score, r.trust) for r in got] == [(1, "entails", 0.7, 0.7), (1, "contradicts", 0.4, 0.4), (2, "neutral", 0.0, 0.0), (3, "neutral", 1.0, 1.0)]
    assert got[1].score_components.stance_raw == -1.0 and got[1].score_components.stance_mapped == 0.0 and got[0].score_components.topic_aligned and got[0].source_url is None and got[0].candidate_type == ""
    assert evidence.evidence_items(rows.limit(0), claims).count() == 0
