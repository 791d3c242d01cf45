"""The same facts in other form: described tables, or tables and text."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tableviews.operators import verbalize
from tableviews.schema import TABLE_KEY
from tableviews.session import stored


class Representation(NamedTuple):
    """Tables of a corpus after verbalization.

    ``tables`` and ``rows`` are the semi-structured version, ``raw_tables`` and
    ``raw_rows`` the complete rows that SQL runs on, ``segments`` the text, ``used`` the
    described columns per sample, ``status`` the outcome per table.
    """

    tables: DataFrame
    rows: DataFrame
    raw_tables: DataFrame
    raw_rows: DataFrame
    segments: DataFrame
    used: DataFrame
    status: DataFrame


def by_column(tables: DataFrame, rows: DataFrame, sets: DataFrame, seed: int = verbalize.SEED) -> Representation:
    """Every complete row gets a sentence that replaces the described columns.

    Tables without a set, and tables of which no row is complete, stay as they are.  The chosen sets are stored, one row
    for each table, as the rows, the status and the tables that stay as they are all ask for them.
    """
    chosen = stored(verbalize.choose_template_sets(tables, sets, seed))
    described = stored(verbalize.describe_rows(rows, chosen, seed))
    status = verbalize.table_status(chosen, described)
    told = status.filter(F.col("status") == verbalize.VERBALIZED)
    untold = status.filter(F.col("status") != verbalize.VERBALIZED).select(*TABLE_KEY)
    kept_rows = rows.join(untold, TABLE_KEY, "left_semi")
    unchanged = chosen.join(untold, TABLE_KEY, "left_semi")
    columns = [c for c in tables.columns]
    raw = verbalize.complete_rows(rows, chosen).select(*rows.columns)
    none = verbalize.paragraphs(described.filter(F.lit(False)))
    return Representation(
        tables=verbalize.described_headers(told).select(*columns).unionByName(unchanged.select(*columns)),
        rows=described.unionByName(kept_rows.select(*TABLE_KEY, "row_pos", "n_rows", "cells"), allowMissingColumns=True),
        raw_tables=tables,
        raw_rows=raw.unionByName(kept_rows.select(*rows.columns)),
        segments=verbalize.text_segments(none),
        used=verbalize.used_columns(told),
        status=status,
    )


def by_row(
    tables: DataFrame, rows: DataFrame, sets: DataFrame, ratio: float = verbalize.ROW_RATIO, seed: int = verbalize.SEED
) -> Representation:
    """An exact share of the complete rows becomes text, the others stay rows.

    Only samples in which some table got a paragraph are kept; tables of such a sample
    that got none keep all their rows in both versions.
    """
    chosen = verbalize.choose_template_sets(tables, sets, seed)
    complete = verbalize.told_rows(rows, chosen, ratio, seed)
    split = verbalize.taken_rows(complete, stored(verbalize.long_table_bounds(complete, ratio)))
    parts = verbalize.paragraphs(split)
    status = verbalize.table_status(chosen, split)
    told = status.filter(F.col("status") == verbalize.VERBALIZED)
    samples = told.select("sample_id").distinct()
    untold = status.filter(F.col("status") != verbalize.VERBALIZED).select(*TABLE_KEY).join(samples, "sample_id", "left_semi")
    whole = rows.join(untold, TABLE_KEY, "left_semi")
    of_told = split.join(told.select(*TABLE_KEY), TABLE_KEY, "left_semi")
    kept = of_told.filter("NOT taken").select(*rows.columns).unionByName(whole.select(*rows.columns))
    return Representation(
        tables=tables.join(samples, "sample_id", "left_semi"),
        rows=kept,
        raw_tables=tables.join(samples, "sample_id", "left_semi"),
        raw_rows=of_told.select(*rows.columns).unionByName(whole.select(*rows.columns)),
        segments=verbalize.text_segments(parts),
        used=verbalize.used_columns(told),
        status=status,
    )
