"""From nested records to the normalized tables, and row-wise changes on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableviews.functions.cells import first_filled, variant_text, variant_type
from tableviews.operators.ordering import spread_join
from tableviews.schema import ROWS_PER_PART, SLICE, TABLE_DDL, TABLE_KEY, UNKNOWN_DB, row_slice, table_slices


# Field names that records of different origin use.
ID_FIELDS = ["id_", "id", "sid", "ID", "qid"]
TRUTH_FIELDS = ["ground_truth", "gt", "answer", "answers", "gold", "label", "labels", "GroundTruth", "gold_answer"]
QUESTION_FIELDS = ["Question", "question"]


def field(path: str, kind: str = "string") -> Column:
    """A field of the record; names are told apart by case."""
    return F.try_variant_get("record", f"$.{path}", kind)


def record_id(records: DataFrame | None = None) -> Column:
    """First filled of the usual id fields, else the place in the input; records of several splits have their split before it."""
    own = F.coalesce(first_filled(*[field(c) for c in ID_FIELDS]), F.col("ord").cast("string"))
    return F.concat_ws("_", "split", own) if records is not None and "split" in records.columns else own


def record_truth() -> Column:
    """First present of the usual ground-truth fields."""
    return F.coalesce(*[field(c, "variant") for c in TRUTH_FIELDS])


def samples_of(records: DataFrame) -> DataFrame:
    """Questions, SQL and answers of a corpus (ord, record), without its tables."""
    return records.select(
        record_id(records).alias("sample_id"),
        "ord",
        F.coalesce(field("db"), F.lit(UNKNOWN_DB)).alias("db"),
        F.coalesce(first_filled(*[field(c) for c in QUESTION_FIELDS]), F.lit("")).alias("question"),
        field("SQL").alias("sql"),
        record_truth().alias("answer"),
        F.coalesce(field("difficulty"), F.lit("unknown")).alias("difficulty"),
    )


def texts_of(records: DataFrame) -> DataFrame:
    """Text segments that records bring along, as (sample_id, table_pos, part, text)."""
    listed = field("verbalized_data", "array<struct<text:string>>")
    return records.select(record_id(records).alias("sample_id"), F.posexplode(listed).alias("table_pos", "s")).select(
        "sample_id", "table_pos", F.lit(0).cast("bigint").alias("part"), F.col("s.text").alias("text")
    )


def tables_of(records: DataFrame, version: str = "tables") -> DataFrame:
    """One row per embedded table; names and tables are paired by position.

    ``version`` is ``tables`` or ``raw_tables``.  A name without a table, or a table
    without a name, is left out.  Of a header with several rows the last one names
    the columns; all of them are kept in ``header_rows``.
    """
    inner = "raw_tables." if version == "raw_tables" else ""
    names = F.coalesce(field(f"{inner}table_names", "array<string>"), F.array().cast("array<string>"))
    tables = F.coalesce(field(f"{inner}tables", f"array<{TABLE_DDL}>"), F.array().cast(f"array<{TABLE_DDL}>"))
    shared = F.least(F.size("names"), F.size("tabs"))
    header = F.coalesce("p.tabs.table_columns", F.array().cast("array<variant>"))
    header_rows = F.transform("header", lambda h: F.try_variant_get(h, "$", "array<string>"))
    multi = (F.size("header") > 0) & F.forall("header", lambda h: variant_type(h) == "ARRAY")
    flat = F.transform("header", lambda h: F.coalesce(variant_text(h), F.lit("None")))
    return (
        records.select(
            record_id(records).alias("sample_id"),
            "ord",
            F.coalesce(field("db"), F.lit(UNKNOWN_DB)).alias("db"),
            F.lower(F.coalesce(field("SQL"), F.lit(""))).alias("sql"),
            names.alias("names"),
            tables.alias("tabs"),
        )
        .select("sample_id", "ord", "db", "sql", F.posexplode(F.slice(F.arrays_zip("names", "tabs"), F.lit(1), shared)).alias("table_pos", "p"))
        .select(
            "sample_id", "ord", "db", "sql", "table_pos",
            F.col("p.names").alias("table_name"),
            header.alias("header"),
            F.coalesce("p.tabs.table_content", F.array().cast("array<array<variant>>")).alias("content"),
            F.col("p.tabs.paragraph").alias("paragraph"),
        )
        .withColumns(
            {
                "columns": F.when(multi, F.element_at(header_rows, -1)).otherwise(flat),
                "header_rows": F.when(multi, header_rows),
                "n_rows": F.size("content").cast("bigint"),
            }
        )
        .withColumn("n_cols", F.size("columns"))
        .drop("header")
    )


def unpaired(records: DataFrame, version: str = "tables") -> DataFrame:
    """Records whose names and tables differ in number, as (sample_id, n_names, n_tables); ``tables_of`` pairs the shorter list."""
    inner = "raw_tables." if version == "raw_tables" else ""
    size = lambda name, kind: F.coalesce(F.size(field(f"{inner}{name}", kind)), F.lit(0))
    sized = records.select(record_id(records).alias("sample_id"), size("table_names", "array<string>").alias("n_names"), size("tables", "array<variant>").alias("n_tables"))
    return sized.filter("n_names <> n_tables")


def beyond_header(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells that no column names, counted per table: (sample_id, table_pos, n_cells); ``cells_of`` leaves them out."""
    extra = F.greatest(F.size("cells") - F.size("columns"), F.lit(0))
    counted = with_tables(rows, tables, "columns").groupBy(*TABLE_KEY).agg(F.sum(extra).alias("n_cells"))
    return counted.filter("n_cells > 0")


def sample_tables(tables: DataFrame) -> DataFrame:
    """Table headers without content."""
    return tables.drop("content", "paragraph")


def rows_of(tables: DataFrame) -> DataFrame:
    """Table rows as parallel arrays of cell text and cell type; rows may be ragged."""
    return tables.select(
        *TABLE_KEY, "n_rows", F.posexplode("content").alias("row_pos", "row")
    ).select(
        *TABLE_KEY,
        F.col("row_pos").cast("bigint").alias("row_pos"),
        "n_rows",
        F.transform("row", lambda v: variant_text(v)).alias("cells"),
        F.transform("row", lambda v: variant_type(v)).alias("vtypes"),
    )


def with_tables(rows: DataFrame, tables: DataFrame, *fields: str) -> DataFrame:
    """Bring header fields to the rows.  Both sides carry the slice, so no table sits in one task."""
    return in_slices(rows, tables, *fields).drop(SLICE)


def in_slices(rows: DataFrame, tables: DataFrame, *fields: str) -> DataFrame:
    """Rows with header fields as in ``with_tables`` and the slice they were joined on; the rows of a slice lie together."""
    sliced = tables.select(*TABLE_KEY, *fields, F.explode(table_slices()).alias(SLICE))
    return rows.withColumn(SLICE, row_slice()).join(sliced, [*TABLE_KEY, SLICE])


def cells_of(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Long form: one row per cell.  A cell beyond the header has no column and is left out."""
    header = with_tables(rows, tables, "db", "ord", "table_name", "columns")
    return header.select(
        "sample_id", "table_pos", "row_pos", "ord", "db", "table_name", "columns", "vtypes",
        F.posexplode("cells").alias("col_pos", "value"),
    ).filter(F.col("col_pos") < F.size("columns")).select(
        "sample_id", "table_pos", "row_pos", "ord", "db", "table_name", "col_pos",
        F.get("columns", F.col("col_pos")).alias("column"),
        "value",
        F.get("vtypes", F.col("col_pos")).alias("vtype"),
    )


def as_records(rows_with_columns: DataFrame) -> DataFrame:
    """Rows as MAP<column, text>; missing cells are NULL, and of a name that repeats the last cell counts."""
    padded = F.transform(F.col("columns"), lambda c, i: F.struct(c.alias("c"), i.alias("i"), F.get("cells", i).alias("v")))
    size = F.size("columns")
    last = F.filter(padded, lambda p: ~F.array_contains(F.slice("columns", p["i"] + 2, F.greatest(size - p["i"] - 1, F.lit(0))), p["c"]))
    return rows_with_columns.withColumn("record", F.map_from_entries(F.transform(last, lambda p: F.struct(p["c"], p["v"]))))


def typed_cell(text: Column, vtype: Column) -> Column:
    """Cell text and type back to a JSON value."""
    quoted = F.to_json(F.struct(text.alias("x")))
    quoted = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    json = (
        F.when(text.isNull() | (vtype == "VOID"), "null")
        .when(vtype.isin("BIGINT", "DOUBLE", "ARRAY", "OBJECT"), text)
        .when(vtype == "BOOLEAN", F.lower(text))
        .otherwise(quoted)
    )
    return F.try_parse_json(json)


def nested_content(rows: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Rows of a table as one nested list, as (sample_id, table_pos, part, table_content)."""
    part = F.floor(F.col("row_pos") / F.lit(rows_per_part)).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("row_pos", "cells", "vtypes")))
    return rows.withColumn("part", part).groupBy(*TABLE_KEY, "part").agg(
        F.transform(ordered, lambda r: F.zip_with(r["cells"], r["vtypes"], typed_cell)).alias("table_content")
    )


def from_cells(cells: DataFrame) -> DataFrame:
    """Long form back to rows; every group is one row of one table."""
    ordered = F.array_sort(F.collect_list(F.struct("col_pos", "value")))
    return cells.groupBy("sample_id", "table_pos", "row_pos").agg(F.transform(ordered, lambda c: c["value"]).alias("cells"))


def cells_at(positions: Column, cells: Column) -> Column:
    """Cells at the given zero-based positions."""
    return F.transform(positions, lambda p: F.get(cells, p))


def complete_in(positions: Column, cells: Column) -> Column:
    """Whether none of the cells at the given positions is missing."""
    return F.forall(positions, lambda p: F.get(cells, p).isNotNull())


def without_positions(positions: Column, values: Column) -> Column:
    """Array without the elements at the given positions."""
    return F.filter(values, lambda _, i: ~F.array_contains(positions, i))


def positions_in(columns: Column, wanted: Column) -> Column:
    """Zero-based position of each wanted name; NULL where it is unknown."""
    return F.transform(wanted, lambda w: F.nullif(F.array_position(columns, w), F.lit(0)).cast("int") - 1)


def drop_empty_columns(rows: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove columns that hold no value in any row; returns rows and tables."""
    seen = (
        rows.select(*TABLE_KEY, F.posexplode("cells").alias("col_pos", "value"))
        .filter(F.col("value").isNotNull())
        .groupBy(*TABLE_KEY, "col_pos")
        .agg(F.lit(1).alias("one"))
        .groupBy(*TABLE_KEY)
        .agg(F.array_sort(F.collect_list("col_pos")).alias("kept"))
    )
    none = F.array().cast("array<int>")
    headed = tables.join(seen, TABLE_KEY, "left").withColumn("kept", F.coalesce("kept", none))
    kept_here = F.col("kept")
    in_header = F.filter(kept_here, lambda p: p < F.size("columns"))
    narrow = headed.withColumn("columns", cells_at(in_header, F.col("columns"))).withColumn("n_cols", F.size("columns"))
    new_rows = with_tables(rows, headed, "kept").withColumns(
        {"cells": cells_at(kept_here, F.col("cells")), "vtypes": cells_at(kept_here, F.col("vtypes"))}
    )
    return new_rows.drop("kept"), narrow.drop("kept")


def rename_columns(tables: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace known misspelt column names; ``aliases`` is (db, old, new).

    Aliases of a database are first gathered into one map, which has one entry per
    known misspelling, and then met by all tables of that database.
    """
    single = aliases.groupBy("db", "old").agg(F.max("new").alias("new"))
    maps = single.groupBy("db").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("__new"))
    found = spread_join(tables, maps, ["db"], TABLE_KEY, "left")
    renamed = F.transform("columns", lambda c: F.coalesce(F.element_at("__new", c), c))
    return found.withColumn("columns", F.when(F.col("__new").isNull(), F.col("columns")).otherwise(renamed)).drop("__new")


def rename_in_sql(samples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Same names in the SQL text, as whole words."""
    lists = aliases.groupBy("db").agg(F.array_sort(F.collect_list(F.struct("old", "new"))).alias("__new"))
    found = spread_join(samples, lists, ["db"], ["sample_id"], "left")
    patched = F.aggregate(
        F.col("__new"), F.col("sql"),
        lambda acc, a: F.regexp_replace(acc, F.concat(F.lit(r"\b"), a["old"], F.lit(r"\b")), a["new"]),
    )
    return found.withColumn("sql", F.when(F.col("__new").isNull(), F.col("sql")).otherwise(patched)).drop("__new")


def well_formed(tables: DataFrame) -> DataFrame:
    """Tables without repeated column names (case does not count)."""
    lowered = F.transform("columns", lambda c: F.lower(c))
    return tables.filter(F.size(F.array_distinct(lowered)) == F.size("columns"))
