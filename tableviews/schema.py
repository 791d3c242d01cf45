"""The normalized data model.

A corpus is four DataFrames that share ``sample_id``:

``samples``        sample_id, ord, split, db, question, sql, answer (VARIANT), difficulty
``sample_tables``  sample_id, ord, db, table_pos, table_name, columns, n_rows, n_cols
``table_rows``     sample_id, table_pos, row_pos, n_rows, cells ARRAY<STRING>, vtypes ARRAY<STRING>
``template_sets``  db, table_name, set_no, columns, templates

``row_pos`` is dense (0 .. n_rows-1) inside a table and ``n_rows`` is repeated on
every row.  Both are set once by the loader, so that later operators can cut a
long table into slices with a row-local expression instead of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# An embedded table inside a record.  Cells keep their JSON type as VARIANT, and so do
# column names, because a header may have several rows.
TABLE_DDL = "struct<table_columns:array<variant>,table_content:array<array<variant>>,paragraph:string>"

TABLE_KEY = ["sample_id", "table_pos"]
UNKNOWN_DB = "UNKNOWN"

# A join on a table's key carries the slice as well, so a table that holds a
# large share of all rows is spread over n_rows / ROWS_PER_SLICE tasks.
ROWS_PER_SLICE = 200_000
SLICE = "__slice"
# Text built from the rows of one table is cut after this many rows.
ROWS_PER_PART = 10_000


def row_slice(rows_per_slice: int = ROWS_PER_SLICE) -> Column:
    """Slice number of a row, computed from ``row_pos`` alone."""
    return F.floor(F.col("row_pos") / F.lit(rows_per_slice)).cast("bigint")


def table_slices(rows_per_slice: int = ROWS_PER_SLICE) -> Column:
    """All slice numbers of a table, from its ``n_rows``; an empty table has slice 0."""
    last = F.greatest(F.lit(0), F.floor((F.col("n_rows") - 1) / F.lit(rows_per_slice)).cast("bigint"))
    return F.sequence(F.lit(0).cast("bigint"), last)
