"""State that follows from events in order: failing domains, drift counters, token buckets.

Each has a batch form as windows over the events, and a streaming form that
keeps one small state per key and agrees with it event by event.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions import search, words

#: Failures that block a domain, seconds that they are remembered and that the block lasts, drift tokens kept.
FAILURES, MEMORY, DRIFT_KEPT = 2, 900.0, 48


def domain_blocks(events: DataFrame, order: list[str]) -> DataFrame:
    """events (domain, at, kind, seconds) with the failures counted, and until when the domain is blocked, after each.

    kind: failure, success or cooldown (blocked for ``seconds``). A failure more
    than MEMORY seconds after the last event starts a new count; a success
    forgets everything. ``at`` is in seconds.
    """
    c = F.col
    by_domain = Window.partitionBy("domain").orderBy(*order)
    before = by_domain.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_life", F.coalesce(F.count_if(c("kind") == "success").over(before), F.lit(0)))
    life = Window.partitionBy("domain", "_life").orderBy(*order)
    so_far = life.rowsBetween(Window.unboundedPreceding, 0)
    last = F.lag("at").over(life)
    fails = c("kind") == "failure"
    rows = rows.withColumn("_new", fails & (last.isNull() | (c("at") - last > MEMORY)))
    rows = rows.withColumn("_run", F.count_if("_new").over(so_far))
    counted = F.count_if(fails).over(Window.partitionBy("domain", "_life", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("failures", F.when(c("kind") == "success", 0).otherwise(counted).cast("long"))
    until = F.when(c("kind") == "cooldown", c("at") + c("seconds")).when(fails & (c("failures") >= FAILURES), c("at") + MEMORY)
    rows = rows.withColumn("blocked_until", F.when(c("kind") == "success", 0.0).otherwise(F.coalesce(F.last(until, ignorenulls=True).over(so_far), F.lit(0.0))))
    return rows.drop("_life", "_new", "_run")


_BLOCKS = "domain string, at double, kind string, failures long, blocked_until double"


def stream_domain_blocks(events: DataFrame) -> DataFrame:
    """domain_blocks() over a stream; the events of a micro-batch are taken in the order of ``at``, kind."""

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, until = state.get if state.exists else (0, 0.0, 0.0)
        out = []
        for row in pd.concat(list(frames)).sort_values(["at", "kind"], kind="stable").itertuples():
            if row.kind == "success":
                count, last, until = 0, 0.0, 0.0
            elif row.kind == "cooldown":
                last, until = row.at, row.at + row.seconds
            else:
                count = 1 if row.at - last > MEMORY else count + 1
                last = row.at
                until = row.at + MEMORY if count >= FAILURES else until
            out.append((key[0], row.at, row.kind, count, until))
        state.update((count, last, until))
        yield pd.DataFrame(out, columns=["domain", "at", "kind", "failures", "blocked_until"])

    return events.groupBy("domain").applyInPandasWithState(run, _BLOCKS, "count long, last double, until double", "append", GroupStateTimeout.NoTimeout)


def drift_tokens(url: Column, title: Column, snippet: Column) -> Column:
    """What a poor search result says about itself."""
    raw = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    path = F.lower(F.substring_index(F.substring_index(F.coalesce(url, F.lit("")), "#", 1), "?", 1))
    pdf = path.endswith(".pdf") | F.arrays_overlap(words.found(raw, r"\b[a-z][a-z0-9\-]{2,}\b"), F.array(F.lit("pdf")))
    return F.array_compact(F.array(F.when(pdf, "pdf"), *[F.when(raw.contains(t), t) for t in search.LOW_TEXTS]))


def drift_counts(results: DataFrame) -> DataFrame:
    """(claim_type, token, n): the DRIFT_KEPT most frequent tokens of each type's poor results; ties by token. Works on streams in complete mode up to the cut."""
    kind = F.upper(F.trim("claim_type"))
    known = F.when(kind.isin(*search.PRIORITY), kind).otherwise("GENERAL")
    each = results.select(known.alias("claim_type"), F.explode(drift_tokens(F.col("url"), F.col("title"), F.col("snippet"))).alias("token"))
    return each.groupBy("claim_type", "token").agg(F.count(F.lit(1)).alias("n"))


def drift_kept(counts: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("claim_type").orderBy(F.desc("n"), "token"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= DRIFT_KEPT)


def stream_token_bucket(requests: DataFrame, limit: int, period: float) -> DataFrame:
    """(name, at, started): when each request of a stream (name, at in seconds) may start.

    A bucket of ``limit`` tokens per name refills evenly over ``period`` seconds;
    a request takes one and waits until there is one. Requests wait in order.
    """

    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (float(limit), None)
        out = []
        for asked in sorted(pd.concat(list(frames))["at"].tolist()):
            now = asked if at is None else max(asked, at)
            if at is not None:
                tokens = min(float(limit), tokens + (now - at) * limit / period)
            if tokens < 1:
                now += (1 - tokens) * period / limit
                tokens = 1.0
            tokens -= 1
            at = now
            out.append((key[0], asked, now))
        state.update((tokens, at))
        yield pd.DataFrame(out, columns=["name", "at", "started"])

    return requests.groupBy("name").applyInPandasWithState(run, "name string, at double, started double", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)
