"""Evaluate an expression once and use its value several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Writing a long expression at several places makes Spark compute it at each of
    them; inside the function of an array transform it is a plain variable.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    A filter on a plain column is moved below it and computes the value a second time,
    at a place with perhaps fewer tasks.  As the only row of a generator it stays put.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))
