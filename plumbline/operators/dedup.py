"""Keep-first and keep-best dedup, by one key or several."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

#: Groups up to which a table of their keys and two figures is broadcast.
BROADCAST_GROUPS = 10_000


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows alike in ``keys`` (null is a key) the one with the smallest ``order``; folds before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def keep_best(df: DataFrame, keys: list[str], score: str, order: str, default: float = 0.0) -> DataFrame:
    """Of rows alike in ``keys`` the one with the largest score, then the smallest ``order``."""
    rank = F.struct(-F.coalesce(F.col(score), F.lit(default)), F.col(order))
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, rank).alias("_row")).select("_row.*")


def keep_confident(df: DataFrame, keys: list[str], score: str, order: str, default: float = 0.5) -> DataFrame:
    """Of rows alike in ``keys`` the one that a fold in ``order`` ends with.

    The next row replaces the one held if its score, or ``default`` where it has
    none, is larger than the score held, 0 where that has none. So a row without
    a score always comes in while the best score is below ``default``, and any
    score above 0 replaces it: what stays is the first best of the rows from the
    last such row on, or of all where a score reaches ``default``.
    """
    c = F.col
    named = {k: f"_k{i}" for i, k in enumerate(keys)}
    gap = F.max(F.when(c(score).isNull(), c(order)))
    # two aggregates that fold before the shuffle, no window: a key that very many rows have fills no task
    held = written(df.groupBy(*[c(k).alias(n) for k, n in named.items()]).agg(F.max(score).alias("_best"), gap.alias("_gap")))
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(n)) for k, n in named.items()])
    in_play = (F.coalesce("_best", F.lit(0.0)) >= default) | c("_gap").isNull() | (c(order) >= c("_gap"))
    rows = df.join(F.broadcast(held) if held.count() <= BROADCAST_GROUPS else held, same).filter(in_play)
    value = F.coalesce(c(score), F.lit(0.0))
    rank = F.struct(~F.isnan(value.cast("double")), -value, c(order))
    return rows.groupBy(*named.values()).agg(F.min_by(F.struct(*[c(x) for x in df.columns]), rank).alias("_row")).select("_row.*")
