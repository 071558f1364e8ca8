"""Values that an expression names more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(rows: DataFrame, columns: dict[str, Column], plain: str) -> DataFrame:
    """``rows`` with long formulas as columns, in a projection of their own.

    Spark writes the steps of a stage into one method, and the JVM never compiles
    a method of more than 8,000 bytes: rows then run through its interpreter. A
    projection that holds a function on arrays stays outside, in methods of its
    own that are short; ``plain``, a column of the rows, goes through one and
    stays as it is.
    """
    return rows.withColumns(columns | {plain: once(F.col(plain), lambda x: x)})
