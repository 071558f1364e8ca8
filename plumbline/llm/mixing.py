"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets the rate of its source, a number of copies with a
fractional part. Fractions are rounded in pairs: words move from one document
to the other, in a direction drawn so that neither expectation changes, until
one of the two is integral; the other meets the next document. A source's words
thus stay at their target but for one last document. Documents are dealt to
buckets of bounded size; each bucket leaves at most one fraction per source,
and these meet in a tree of buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.ranges import with_running_sum
from plumbline.session import cut, written

#: Documents of one source that make a bucket on average, and buckets whose residuals meet in one of the next level.
BUCKET_ROWS, FAN_IN = 1024, 64
#: Sources up to which their table may be broadcast (some tens of MB).
BROADCAST_SOURCES = 200_000
EPS = 1e-9


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float], share: float, cap: float) -> dict[str | None, float]:
    """Each source's words: ``share`` of all words by weight, none above ``cap`` times its size.

    Sources take the weights in turn, in code point order, null last. What the
    cap cuts off goes to the others by weight, until none is above. This is the
    plain version of source_targets(), for sizes that lie in memory.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in order if s in free and unit * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
            free.discard(s)
    return out


def source_targets(rows: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(src, none, source_size, n, target) of the sources of ``rows`` (source, size), as a table: there may be many sources.

    A source's place in code point order, null last, is a running count over
    ranges. Words per weight are worked out in rounds: a round takes out the
    sources that would get more than their cap, and ends when none does.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sums = sums.select(F.col("source").isNull().alias("none"), F.col("source").alias("src"), "source_size", "n")
    placed = with_running_sum(sums, ["none", "src"], F.lit(1).cast("long"), "place")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("place", F.lit(len(weights))).cast("int"))
    known = cut(placed.select("src", "none", "source_size", "n", weight.alias("weight")))
    goal = share * (known.agg(F.sum("source_size").alias("s")).first()["s"] or 0)
    capped, unit = F.lit(False), 0.0
    while True:
        got = known.agg(F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("w"), F.sum(F.when(capped, cap * F.col("source_size")).otherwise(0.0)).alias("c"), F.count_if(capped).alias("k")).first()
        if not got["w"]:
            break
        unit = (goal - got["c"]) / got["w"]
        more = capped | (unit * F.col("weight") > cap * F.col("source_size"))
        if known.filter(more).count() == got["k"]:
            break
        # the words per weight only grow from round to round, so who was out stays out
        capped = F.lit(unit) * F.col("weight") > cap * F.col("source_size")
    target = F.when(capped, cap * F.col("source_size")).otherwise(unit * F.col("weight"))
    return known.select("src", "none", "source_size", "n", target.cast("double").alias("target"))


def settle(size: np.ndarray, p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions ``p`` of documents of ``size`` words; the place of the one left, or -1.

    Keeps sum(size * p), but for documents without words, whose fraction is dropped.
    """
    p = p.copy()
    held = -1
    for i in range(len(p)):
        if size[i] == 0 or p[i] < EPS:
            p[i] = 0.0
            continue
        if p[i] > 1 - EPS:
            p[i] = 1.0
            continue
        if held < 0:
            held = i
            continue
        up = min((1 - p[held]) * size[held], p[i] * size[i])
        down = min(p[held] * size[held], (1 - p[i]) * size[i])
        moved = up if draws[i] * (up + down) < down else -down
        p[held] += moved / size[held]
        p[i] -= moved / size[i]
        for j in (held, i):
            if p[j] < EPS or p[j] > 1 - EPS:
                p[j] = round(p[j])
        free = [j for j in (held, i) if 0 < p[j] < 1]
        held = free[0] if free else -1
    return p, held


def _level(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # large documents first, so that what is left at the end tends to be small
        rows = rows.sort_values(["size", "draw", "id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        source, bucket = key
        none = source is None or source != source
        rng = np.random.default_rng([seed, level, int(bucket), zlib.crc32(b"" if none else source.encode()), int(none)])
        draws = rng.random(len(rows) + 1)
        p, held = settle(rows["size"].to_numpy(np.float64), rows["p"].to_numpy(np.float64), draws)
        if last and held >= 0:
            p[held] = float(draws[-1] < p[held])
        return rows.assign(p=p)

    return run


def _salted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``salt``: 0, but where more than BUCKET_ROWS rows have one draw, as rows alike in id and text do, a number that changes every BUCKET_ROWS of them.

    Such rows are the same to the mix, so it does not matter which one has which number.
    """
    same = written(rows.groupBy("draw").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BUCKET_ROWS))
    if not same.limit(1).count():
        return rows.withColumn("salt", F.lit(0).cast("long"))
    marked = rows.join(same, "draw", "left")
    alike = marked.filter("_n IS NOT NULL").drop("_n").withColumn("_row", F.monotonically_increasing_id())
    alike = with_running_sum(alike, ["draw", "_row"], F.lit(1).cast("long"), "_before").withColumn("salt", F.floor(F.col("_before") / BUCKET_ROWS).cast("long"))
    single = marked.filter("_n IS NULL").drop("_n").withColumn("salt", F.lit(0).cast("long"))
    return single.unionByName(alike.drop("_row", "_before"))


def mix_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document, ``taken`` the words of
    that. Sources are a table of their own, broadcast where it is small. Runs
    agree for the same rows, however they are partitioned. Null text has size 0;
    documents without words are taken floor(rate) times, which adds no words. A
    null source is a source of its own, the last one. Repeated rows are
    documents each; which of them is taken more often is not told apart, and
    where very many are alike they are spread over buckets like others. An empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("draw")))
    known = cut(source_targets(rows, weights, share, cap))
    rows = _salted(rows)
    counts = known.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("most")).first()
    small = counts["sources"] <= BROADCAST_SOURCES
    known = known.withColumn("own", F.ceil(F.col("n") / BUCKET_ROWS)).drop("n").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = rows.join(F.broadcast(known) if small else known, F.col("source").eqNullSafe(F.col("src"))).drop("src", "none")
    buckets = max(1, -(-(counts["most"] or 0) // BUCKET_ROWS))  # of the largest source
    rated = rated.select("*", F.floor(F.col("rate") + EPS).cast("int").alias("whole"), F.pmod(F.pmod("draw", "own") + F.col("salt"), "own").alias("bucket")).drop("own", "salt")
    rated = rated.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    done, level = [], 0
    schema = T.StructType([f for f in rated.schema if f.name != "rate"])
    open_rows = rated.drop("rate")
    while True:
        last = buckets == 1
        out = cut(open_rows.groupBy("source", "bucket").applyInPandas(_level(seed, level, last), schema))
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(out.filter(settled))
        if last:
            break
        buckets, level = -(-buckets // FAN_IN), level + 1
        open_rows = out.filter(~settled).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    copies = (F.col("whole") + F.col("p").cast("int")).cast("int")
    return every.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Rows alike in id, source and size share their copies evenly, in the order of
    their texts.
    """
    from pyspark.sql import Window

    rates = mix_rates(docs, id_col, text_col, source_col, **options)
    keys = [F.col(id_col).alias("_i"), F.col(source_col).cast("string").alias("_s"), F.col("size").alias("_n")]
    per = rates.select(*keys, "copies").groupBy("_i", "_s", "_n").agg(F.sum("copies").alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    names = docs.columns
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_src"), count_words(F.col(text_col)).alias("_size"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n"))
    both = wide.join(per, same)
    single = both.filter("_rows = 1").select("_row", F.col("_sum").cast("int").alias("_c"))
    turn = F.row_number().over(Window.partitionBy("_id", "_src", "_size").orderBy(F.col("_row").getField(text_col)))
    share = F.floor(F.col("_sum") / F.col("_rows")) + (turn <= F.col("_sum") % F.col("_rows")).cast("int")
    several = both.filter("_rows > 1").select("_row", share.cast("int").alias("_c"))
    return single.union(several).filter("_c > 0").select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_c")))).select("_row.*")
