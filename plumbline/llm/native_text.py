"""Pieces of column expressions shared by the operators that stay on built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, also where ``body`` names it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def count_class(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars`` (ASCII, taken literally)."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


#: Items of a block of prefix_sums().
BLOCK = 64


def prefix_sums(values: Column) -> Column:
    """Sums up to and with each item of an array of integers.

    Block by block, so that the work is a fixed number of steps an item; a fold
    that appends to its result copies it for every item.
    """

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def in_blocks(blocks: Column) -> Column:
        def placed(sums: Column) -> Column:
            def ends(block: Column, b: Column) -> Column:
                return let(total(F.slice(sums, 1, b)), lambda before: F.transform(block, lambda _, i: before + total(F.slice(block, 1, i + 1))))

            return F.flatten(F.transform(blocks, ends))

        return let(F.transform(blocks, total), placed)

    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
    return let(F.transform(starts, lambda i: F.slice(values, i, BLOCK)), in_blocks)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern that matches no empty string.

    An array of (s, e, v): start and exclusive end in code points, and the text
    of ``group``. split() and regexp_extract_all() see the same matches, so the
    pieces between them give the places; texts without a match skip both.
    """

    def placed(x: Column) -> Column:
        steps = F.transform(x["w"], lambda w, i: F.length(F.get(x["p"], i)) + F.length(w))
        return let(prefix_sums(steps), lambda ends: F.transform(x["w"], lambda w, i: F.struct((F.get(ends, i) - F.length(w)).alias("s"), F.get(ends, i).alias("e"), F.get(x["v"], i).alias("v"))))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    return F.when(text.rlike(pattern), let(F.struct(F.split(text, pattern, -1).alias("p"), whole.alias("w"), part.alias("v")), placed)).otherwise(none)
