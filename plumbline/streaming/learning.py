"""Search results that teach what the next queries leave out: a batch form and a stateful stream that agrees with it.

A row is a query with all its results. Results are judged on their own; those
that fail teach the marks that they bear. A query leaves out the marks that
earlier queries of its claim type have learned within the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions import domains, search
from plumbline.functions.once import once
from plumbline.operators.state import drift_tokens
from plumbline.session import by_value, written

#: Results that a query's quality is judged by, how many are taken for two, one and no good one among them, and results that are looked at.
HEAD, TAKEN, LOOKED_AT = 3, (3, 5, 8), 8
#: Every mark that a poor result can bear.
MARKS = ("pdf", *search.LOW_TEXTS)


def _page(u: Column, title: Column, snippet: Column) -> Column:
    """What processed() reads in a result alone: its address, whether it is usable, its page_signals() and its marks."""
    usable = (F.coalesce(u, F.lit("")) != "") & domains.is_trusted(u) & search.reject_reason(u, title, snippet).isNull()
    return F.struct(u.alias("url"), usable.alias("usable"), search.page_signals(u, title, snippet).alias("read"), drift_tokens(u, title, snippet).alias("marks"))


def with_pages(results: DataFrame) -> DataFrame:
    """Search results, a row each (url, title, snippet, ..), with ``page`` for processed(), worked out once for each distinct result."""
    made = lambda v: v.withColumn("page", _page(F.col("url"), F.col("title"), F.col("snippet")))
    return by_value(results, ["url", "title", "snippet"], made)


def processed(queries: DataFrame) -> DataFrame:
    """queries (claim_type, anchors, at, results: array of url, title, snippet) with trusted, selected and learned.

    Results of trusted domains without a reason to reject them are kept in
    order; by how many of the first three pass the gate, 3, 5 or 8 of the first
    eight are selected, best score first, then by address; where none is, all
    trusted ones are. learned are the marks of trusted results that fail.
    Instead of results there may be pages: those of with_pages(), in order; the
    ones that are not usable may be left out.
    """
    none = F.array().cast("array<string>")
    if "pages" in queries.columns:
        kept = F.filter(F.coalesce("pages", F.array().cast(queries.schema["pages"].dataType)), lambda p: p["usable"])
    else:
        listed = F.coalesce("results", F.array().cast("array<struct<url:string,title:string,snippet:string>>"))
        kept = F.filter(F.transform(listed, lambda r: _page(r["url"], r["title"], r["snippet"])), lambda p: p["usable"])
    # an address that comes again is the first one
    first = once(kept, lambda k: F.filter(k, lambda r, i: ~F.exists(F.slice(k, 1, i), lambda o: o["url"] == r["url"])))

    def judged(p: Column) -> Column:
        gate = search.page_gate(F.col("claim_type"), F.col("anchors"), p["read"])
        return once(gate, lambda g: F.struct(p["url"].alias("url"), g["passed"].alias("passed"), g["score"].alias("score"), F.when(~g["passed"], p["marks"]).otherwise(none).alias("marks")))

    rows = queries.withColumn("_r", F.transform(first, judged))
    good = F.size(F.filter(F.slice("_r", 1, HEAD), lambda r: r["passed"]))
    take = F.when(good >= 2, TAKEN[0]).when(good == 1, TAKEN[1]).otherwise(TAKEN[2])
    ranked = F.array_sort(F.transform(F.slice("_r", 1, LOOKED_AT), lambda r: F.struct((-r["score"]).alias("s"), r["url"].alias("url"))))
    rows = rows.withColumns({
        "trusted": F.transform("_r", lambda r: r["url"]), "selected": F.transform(F.slice(ranked, F.lit(1), take), lambda r: r["url"]),
        "learned": F.array_sort(F.array_distinct(F.flatten(F.transform("_r", lambda r: r["marks"])))),
    })
    return rows.drop("_r")


def with_learned(rows: DataFrame, memory: float, bucket: float = 3600.0) -> DataFrame:
    """processed() rows (at in seconds) with ``left_out``: the marks that queries of the type have learned before, at most ``memory`` seconds ago.

    A type's queries are dealt by buckets of time: what each bucket has learned
    last is a row of a few numbers, whose running maximum is all that later
    buckets need; inside a bucket a window does the rest. Queries of one moment
    do not teach each other. The rows are written once, as they are read twice.
    """
    c = F.col
    at = {m: F.max(F.when(F.array_contains("learned", m), c("at"))) for m in MARKS}
    held = written(rows.withColumn("_b", F.floor(c("at") / bucket)))
    ends = held.groupBy("claim_type", "_b").agg(*[x.alias(f"_e{i}") for i, x in enumerate(at.values())])
    before = Window.partitionBy("claim_type").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("claim_type", "_b", *[F.max(f"_e{i}").over(before).alias(f"_p{i}") for i in range(len(MARKS))])
    earlier = Window.partitionBy("claim_type", "_b").orderBy(F.round(c("at") * 1e6).cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    out = held.join(ends, ["claim_type", "_b"])
    last = [F.greatest(x.over(earlier), c(f"_p{i}")) for i, x in enumerate(at.values())]
    marks = F.array_compact(F.array(*[F.when(c("at") - t <= memory, F.lit(m)) for m, t in zip(MARKS, last, strict=True)]))
    return out.withColumn("left_out", F.array_sort(marks)).drop("_b", *[f"_p{i}" for i in range(len(MARKS))])


class Learner(StatefulProcessor):
    """The marks of a claim type with the time that each was learned last; those past the memory are forgotten."""

    def __init__(self, memory: float, ttl_ms: int | None):
        self.memory, self.ttl_ms = memory, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getMapState("marks", "mark string", "at double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {m[0]: v[0] for m, v in self.marks.iterator()}
        out = []
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        for at, group in frame.groupby("at", sort=True):
            known = {m: t for m, t in known.items() if at - t <= self.memory}
            left = sorted(known)
            for row in group.itertuples():
                out.append((key[0], row.query, at, left))
            for row in group.itertuples():
                known.update(dict.fromkeys(row.learned, at))
        for m in [m[0] for m in self.marks.keys()]:
            if m not in known:
                self.marks.removeKey((m,))
        for m, t in known.items():
            self.marks.updateValue((m,), (t,))
        yield pd.DataFrame(out, columns=["claim_type", "query", "at", "left_out"])

    def close(self) -> None:
        pass


def stream_learned(rows: DataFrame, memory: float, ttl_ms: int | None = None) -> DataFrame:
    """(claim_type, query, at, left_out) of a stream of processed() rows (with query), as with_learned() has it where batches come in the order of ``at``.

    ``ttl_ms`` is the store's own time to live, by the clock, for types that are
    never asked again. Needs the RocksDB state store.
    """
    asked = rows.select("claim_type", "query", "at", "learned")
    return asked.groupBy("claim_type").transformWithStateInPandas(Learner(memory, ttl_ms), "claim_type string, query string, at double, left_out array<string>", "append", "none" if ttl_ms is None else "processingTime")
