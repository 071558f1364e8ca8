"""Decisions on domains, the facts they touch, and the interval of a claim's trust."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import domains, urls


def newest_decisions(decisions: DataFrame) -> DataFrame:
    """(domain, approved, at, seq) to the last decision on each domain."""
    return decisions.groupBy(F.lower("domain").alias("domain")).agg(F.max_by("approved", F.struct("at", "seq")).alias("approved"))


def validated(facts: DataFrame, decisions: DataFrame, url: str = "source_url") -> DataFrame:
    """facts with validation_state and verdict_state, by trusted roots and then by decisions."""
    known = decisions.select(F.col("domain").alias("_domain"), F.col("approved").alias("_approved"))
    joined = facts.join(known, urls.host(F.col(url)) == F.col("_domain"), "left")
    state = domains.validation_state(F.col(url), F.col("_approved"))
    return joined.withColumn("validation_state", state).withColumn("verdict_state", domains.verdict_state(F.col("validation_state"))).drop("_domain", "_approved")


def revalidation_events(pending: DataFrame, decisions: DataFrame) -> DataFrame:
    """(fact_id, domain, old and new states) of pending facts whose verdict state a decision changes."""
    old = pending.withColumnsRenamed({"validation_state": "old_validation_state", "verdict_state": "old_verdict_state"})
    new = validated(old, decisions).filter(~F.col("old_verdict_state").eqNullSafe(F.col("verdict_state")))
    return new.select("fact_id", urls.host(F.col("source_url")).alias("domain"), "old_validation_state", "old_verdict_state", F.col("validation_state").alias("new_validation_state"), F.col("verdict_state").alias("new_verdict_state"))


def _interval(trust: list[float], keys: list[str], draws: int) -> tuple[float, float]:
    """2.5 and 97.5 per cent of the trust of ``draws`` resamples.

    The seed follows from the evidence's keys, and the draws are those of the
    standard generator, as the figures must be the same everywhere.
    """
    n, x = len(trust), np.array(trust, dtype=np.float64)
    post = lambda xs: sum(x * x for x in xs) / sum(xs) if sum(xs) > 0 else 0.0
    if n < 2:
        return (post(trust),) * 2
    digest = hashlib.md5("".join(sorted(keys)).encode()).hexdigest()
    rng = random.Random(int(digest, 16) % 2**32)
    # choice() takes the first bits of the generator's next word and passes over numbers from n on: here for all draws at once
    picks, shift = np.empty(0, dtype=np.uint32), 32 - n.bit_length()
    while len(picks) < draws * n:
        more = np.frombuffer(rng.randbytes(4 * (2 * draws * n - len(picks))), dtype="<u4") >> shift
        picks = np.concatenate([picks, more[more < n]])
    picks = picks[: draws * n].reshape(draws, n)
    drawn = x[picks]
    total = drawn.sum(axis=1)
    runs = np.divide((drawn * drawn).sum(axis=1), total, out=np.zeros(draws), where=total > 0)

    def nth(k: int) -> float:
        # numpy adds up otherwise than sum(): the runs around the k-th are added up again
        near = np.abs(runs - np.partition(runs, k)[k]) <= 1e-12
        below = int(((runs < np.partition(runs, k)[k]) & ~near).sum())
        rows = list(map(tuple, picks[near].tolist()))
        known = {t: post([trust[i] for i in t]) for t in set(rows)}
        return sorted(known[t] for t in rows)[k - below]

    return nth(int(0.025 * draws)), nth(int(0.975 * draws))


def trust_interval(ranked: DataFrame, draws: int = 200) -> DataFrame:
    """Bootstrap interval per claim over ranked evidence (claim_id, rank, trust, key), which holds at most k rows per claim.

    The few rows of a claim are folded to arrays first, so Python sees one row per claim in Arrow batches.
    """
    per_claim = ranked.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "trust", "key"))).alias("rows"))
    per_claim = per_claim.select("claim_id", F.col("rows.trust").alias("trust"), F.col("rows.key").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [_interval(t, k, draws) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([e[0] for e in ends], pa.float64()), pa.array([e[1] for e in ends], pa.float64())], names=["claim_id", "ci_low", "ci_high"])

    return per_claim.mapInArrow(run, "claim_id long, ci_low double, ci_high double")
