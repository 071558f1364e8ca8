"""The rank phase against a plain loop over the same ranked rows."""

from collections import defaultdict

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import policy, stance
from plumbline.operators import logic, tracking
from plumbline.plans import registry, worded  # noqa: F401  the registry comes first
from plumbline.plans.ranking import _ranked

SF = "/root/testdata/sf0.001"


def clamp(x):
    return min(1.0, max(0.0, x))


def by_loop(spark, ranked, claims, k=5):
    """[(claim_id, rank, statement, source_url, stance, final_score, core)]; conflicts of one source are settled by their own tested operator."""
    c = F.col
    rows = ranked.join(claims.select("claim_id", "must_have", c("entities").alias("claim_entities")), "claim_id")
    rows = rows.withColumns({"off": policy.family_mismatch(c("statement"), c("claim"), c("claim_entities")), "st": stance.stance(c("claim"), c("statement")), "core": policy.has_must_have(c("statement"), c("must_have"))})
    rows = rows.withColumn("damping", policy.neutral_graph_damping(c("st"), c("w_sem") * c("sem"), c("kg"), c("claim_overlap"), c("anchor_match_score"), c("predicate_match")))
    names = ["claim_id", "statement", "source_url", "st", "core", "damping", "off", "contradict_score", "support_score", "negation_anchor", "predicate_match", "final_score", "conflict", "w_sem", "sem", "credibility", "anchor_match_score"]
    held = defaultdict(list)
    for r in rows.select(*names).collect():
        if r.off:
            continue
        x = r.asDict()
        against = r.st == "contradicts"
        stage = round(clamp(0.42 * r.contradict_score + 0.30 * r.negation_anchor + 0.18 * (1 - r.predicate_match) + (0.10 if against else 0)), 9)
        score = r.final_score
        if against:
            score *= 0.97 if stage >= 0.60 else 0.84
            score = min(0.99, score + 0.04) if r.conflict else score
        x["final"] = round(score * (1 - r.damping), 9)
        x["vector"] = r.w_sem * r.sem
        held[r.claim_id].append(x)
    ordered = []
    for group in held.values():
        group.sort(key=lambda x: (-x["final"], -x["vector"], -x["credibility"], x["statement"], x["source_url"] is not None, x["source_url"] or ""))
        ordered += [(x["claim_id"], n, x["statement"], x["source_url"], x["final"], x["anchor_match_score"], x["support_score"], x["contradict_score"], x["credibility"]) for n, x in enumerate(group, 1)]
    table = spark.createDataFrame(ordered, "claim_id long, seq int, statement string, source_url string, final_score double, anchor_match_score double, support_score double, contradict_score double, credibility double")
    left = {(r.claim_id, r.seq) for r in logic.without_conflicts(table).select("claim_id", "seq").collect()}
    out = []
    for claim, group in held.items():
        group = [x for n, x in enumerate(group, 1) if (claim, n) in left]
        strong = max(x["contradict_score"] for x in group) >= 0.62 and max(x["support_score"] for x in group) <= 0.72
        opposed = [x for x in group if x["st"] == "contradicts"]
        others = [x for x in group if x["st"] != "contradicts"]
        quota = min(2 if strong else 1, len(opposed))
        first = [*others[: k - quota], *opposed[:quota]]
        spare = [*others[k - quota :], *opposed[quota:]]
        picked = (first + spare)[:k]
        picked.sort(key=lambda x: (not x["core"], -x["final"], -x["support_score"], -x["vector"], x["statement"], x["source_url"] is not None, x["source_url"] or ""))
        out += [(claim, n, x["statement"], x["source_url"], x["st"], x["final"], x["core"]) for n, x in enumerate(picked, 1)]
    return sorted(out, key=repr)


def test_rank_phase(spark):
    claims = worded.claims(spark, SF).withColumn("must_have", F.slice(F.coalesce("entities", F.array().cast("array<string>")), 1, 1))
    ranked = _ranked(spark, SF).cache()
    got = tracking.rank_phase(ranked, claims)
    rows = sorted(((r.claim_id, r["rank"], r.statement, r.source_url, r.stance, round(r.final_score, 9), r.core) for r in got.collect()), key=repr)
    want = by_loop(spark, ranked, claims)
    assert len(rows) == len(want) > 500
    assert [r[:5] + r[6:] for r in rows] == [w[:5] + w[6:] for w in want]
    assert all(abs(r[5] - w[5]) < 2e-9 for r, w in zip(rows, want, strict=True))
    sizes = got.groupBy("claim_id").count().agg(F.max("count")).first()[0]
    assert sizes == 5 and got.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("claim_id"))).filter("rank > n").count() == 0
