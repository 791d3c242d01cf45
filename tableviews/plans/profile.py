"""The usage profile that column requests start from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tableviews.operators import profile


def usage_profile(tables: DataFrame, rows: DataFrame, by_name: bool = False) -> DataFrame:
    """Used and unused columns with the examples of every column, per table."""
    keys = ["table_name"] if by_name else ["db", "table_name"]
    used = profile.column_usage(tables, by_name=by_name)
    examples = profile.examples_map(profile.column_examples(rows, tables, by_name=by_name), by_name)
    return used.join(examples, keys, "left").orderBy("table_name", *[k for k in keys if k != "table_name"])


def high_freq_profile(tables: DataFrame, rows: DataFrame, by_name: bool = False) -> DataFrame:
    """Often and seldom used columns with examples, per table."""
    keys = ["table_name"] if by_name else ["db", "table_name"]
    high = profile.high_freq_columns(tables, by_name=by_name)
    examples = profile.examples_map(profile.column_examples(rows, tables, retry=True, by_name=by_name), by_name)
    return high.join(examples, keys, "left").orderBy("table_name", *[k for k in keys if k != "table_name"])
