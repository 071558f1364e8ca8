"""Rounds of retrieval for all claims at once: each one only for the claims that are still open."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import alignment, dedup, evidence
from plumbline.session import cut

#: Most rounds, trust that is enough, least gain of a round, rows of evidence that a claim keeps, and why a claim stops.
ROUNDS, ENOUGH, LEAST_GAIN, POOL = 3, 0.75, 0.02, 30
MET, NO_GAIN, NOTHING_NEW, SEARCH = "stop_threshold_met", "stop_no_improvement", "stop_no_new_evidence", "trigger_corrective"
#: Score of a vector match that stays without an anchor, and what a graph candidate gains by a source.
STRONG_MATCH, SOURCE_GAIN = 0.72, 0.05


def trust_rounds(claims: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], enrich: Callable[[DataFrame, int], DataFrame], now: Column, source_score: Column, rounds: int = ROUNDS) -> DataFrame:
    """States (claim_id, round, trust_post, agreement, gain, evidence, new, decision, stop_reason) of each claim's rounds.

    ``retrieve(open claims, round)`` gives rows of evidence (evidence_id,
    semantic_score, source_url, statement, published_at, stance);
    ``enrich(claims to search for, round)`` adds to the stores that the next
    retrieval reads, and gives the claim_ids for which it found anything. A claim
    without evidence has trust 0. The number of rounds is small and fixed, each
    is written once, and claims that stop take no part in the next.
    """
    still, pool, states = claims.select("claim_id"), None, []
    last = still.withColumn("before", F.lit(0.0))
    for number in range(1, rounds + 1):
        found = cut(evidence.with_trust(retrieve(still, number), now, source_score))
        fresh = found.groupBy("claim_id").agg(F.count(F.lit(1)).alias("new"))
        rows = found if pool is None else pool.join(still, "claim_id", "left_semi").unionByName(found)
        pool = cut(evidence.trust_ranked(rows, POOL).drop("rank", "key"))
        figures = evidence.claim_metrics(pool.withColumn("key", evidence.evidence_key(F.col("source_url"), F.col("statement")))).select("claim_id", "trust_post", "agreement", F.col("n").alias("evidence"))
        state = last.join(figures, "claim_id", "left").join(fresh, "claim_id", "left").na.fill(0, ["trust_post", "agreement", "evidence", "new"])
        trust = F.round("trust_post", 9)
        gain = F.round(F.col("trust_post") - F.col("before"), 9)
        decision = F.when(trust >= ENOUGH, MET).when((gain < LEAST_GAIN) & F.lit(number > 1), NO_GAIN).otherwise(SEARCH)
        state = state.withColumns({"round": F.lit(number), "gain": gain, "decision": decision})
        going = state.filter(F.col("decision") == SEARCH).select("claim_id")
        hits = enrich(going, number).select("claim_id").distinct().withColumn("hit", F.lit(True))
        reason = F.when(F.col("decision") != SEARCH, F.col("decision")).when(F.col("hit").isNull(), NOTHING_NEW)
        state = cut(state.join(hits, "claim_id", "left").withColumn("stop_reason", reason).drop("hit"))
        states.append(state.drop("before"))
        last = state.filter("stop_reason IS NULL").select("claim_id", F.col("trust_post").alias("before"))
        still = last.select("claim_id")
    return reduce(DataFrame.unionByName, states)


def retrieval_phase(claims: DataFrame, semantic: DataFrame, lexical: DataFrame, graph: DataFrame) -> DataFrame:
    """All candidates of each claim's round, as side, statement, source_url, score.

    claims: claim_id, claim, anchors. semantic: vector matches of all its queries
    (seq, statement, source_url, score, entities, context_entities,
    claim_context_match). lexical: BM25
    hits with ``score`` as the best cosine to a query and ``bm25``; those without a
    positive one go. graph: subject, relation, object, statement, source_url and
    the scores of a path. A vector match stays if it is of the claim's context,
    meets an anchor or a claim's word, or is strong; a graph candidate must meet
    one. A claim without anchors filters nothing. Of vector matches alike in
    statement and source the best stays.
    """
    c = F.col
    text = lambda x: F.coalesce(c(x), F.lit(""))
    context = alignment.claim_context(claims).select("claim_id", "usable", "claim_tokens")
    filtered = F.size("usable") > 0
    merged = semantic.withColumn("bm25", F.lit(None).cast("double")).unionByName(lexical.filter("score > 0").select(*semantic.columns, "bm25")).join(context, "claim_id")
    own = alignment.tokens_of(F.concat(F.array("statement"), *[F.coalesce(c(x), F.array().cast("array<string>")) for x in ("entities", "context_entities")]))
    meets = alignment.meets_claim(own, c("usable"), c("claim_tokens"))
    stays = ~filtered | F.coalesce(c("claim_context_match"), F.lit(False)) | (F.coalesce("score", F.lit(0.0)) >= STRONG_MATCH) | meets
    kept = merged.filter(stays).withColumn("said", F.lower(F.trim(text("statement"))))
    best = dedup.keep_best(kept, ["claim_id", "said", "source_url"], "score", "seq")
    said = F.trim(F.array_join(F.filter(F.array(F.trim(text("subject")), F.trim(F.replace(text("relation"), F.lit("_"), F.lit(" "))), F.trim(text("object"))), lambda p: p != ""), " "))
    around = alignment.tokens_of(F.array("subject", "object", "relation", "statement"))
    raw = F.greatest(*[F.coalesce(c(x), F.lit(0.0)) for x in ("kg_score_raw", "kg_score", "confidence", "path_quality_score", "score")])
    lifted = F.when(F.trim(text("source_url")) != "", F.least(F.lit(1.0), raw + SOURCE_GAIN)).otherwise(raw)
    paths = graph.join(context, "claim_id").filter(~filtered | alignment.meets_claim(around, c("usable"), c("claim_tokens")))
    spoken = F.when(F.trim(text("statement")) == "", said).otherwise(c("statement"))
    kg = paths.select("claim_id", "seq", F.lit("kg").alias("side"), spoken.alias("statement"), "source_url", F.greatest(F.coalesce("score", F.lit(0.0)), lifted).alias("score"))
    return best.select("claim_id", "seq", F.lit("sem").alias("side"), "statement", "source_url", "score").unionByName(kg)


#: How much less a further round asks for, and the least that any asks for.
EASING, FLOOR = 0.04, 0.55
ENOUGH_NOW, FEW_URLS, LAST_ROUND = "threshold met", "not enough new urls", "last round"


def reinforced(ranked: DataFrame, known: DataFrame, search: Callable[[DataFrame, int], DataFrame], rank: Callable[[DataFrame, int], DataFrame], threshold: float, rounds: int = ROUNDS, least_new: int = 1) -> tuple[DataFrame, DataFrame]:
    """(ranked rows after up to ``rounds`` rounds of search, (claim_id, rounds, reason) for each claim).

    A claim (ranked: claim_id, final_score, ..) whose best score reaches the
    threshold is done. For the others ``search(rows below the threshold, round)``
    gives (claim_id, url), of which those in ``known`` do not count; a claim with
    fewer than ``least_new`` new ones stops as it is. ``rank(their new urls,
    round)`` reads and stores them and gives those claims' new ranked rows. Each
    round asks for EASING less, FLOOR at least. Claims that no row names take no
    part. Every round is written once.
    """
    # rows are dealt by claim once, and written once; the rounds are decided on a line for each claim
    figures = lambda x: cut(x.filter("claim_id IS NOT NULL").groupBy("claim_id").agg(F.round(F.max("final_score"), 9).alias("best")))
    parts, urls, ends = [cut(ranked.repartition("claim_id"))], known.select("claim_id", "url").distinct(), []
    best, still = figures(parts[0]), None
    for number in range(1, rounds + 1):
        open_ = best.filter(F.col("best") < round(threshold, 9)).select("claim_id")
        ends.append(best.filter(F.col("best") >= round(threshold, 9)).select("claim_id", F.lit(number - 1).alias("rounds"), F.lit(ENOUGH_NOW).alias("reason")))
        weak = reduce(DataFrame.unionByName, parts).filter(F.round("final_score", 9) < round(threshold, 9)).join(open_, "claim_id", "left_semi")
        found = cut(search(weak, number).select("claim_id", "url").distinct().join(urls, ["claim_id", "url"], "left_anti"))
        going = found.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_new).select("claim_id")
        ends.append(open_.join(going, "claim_id", "left_anti").select("claim_id", F.lit(number - 1).alias("rounds"), F.lit(FEW_URLS).alias("reason")))
        fresh = found.join(going, "claim_id", "left_semi")
        again = cut(rank(fresh, number).repartition("claim_id"))
        made, still = figures(again), cut(going)
        parts = [x.join(made, "claim_id", "left_anti") for x in parts] + [again]
        urls = cut(urls.unionByName(fresh))
        anew = made.select("claim_id", F.col("best").alias("_best"), F.lit(True).alias("_made"))
        best = cut(still.join(best, "claim_id").join(anew, "claim_id", "left").select("claim_id", F.when(F.col("_made"), F.col("_best")).otherwise(F.col("best")).alias("best")))
        threshold = max(threshold - EASING, FLOOR)
    ends.append(still.select("claim_id", F.lit(rounds).alias("rounds"), F.lit(LAST_ROUND).alias("reason")))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, ends)
