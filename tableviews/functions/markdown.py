"""Markdown tables: one line per row when writing, arrays of cells when reading."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tableviews.functions.binding import bind
from tableviews.functions.cells import shown


def table_line(cells: Column) -> Column:
    """``| a | b |`` with missing cells written out."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, shown), " | "), F.lit(" |"))


def header_line(columns: Column) -> Column:
    return table_line(columns)


def blank_safe_header_line(columns: Column) -> Column:
    """Header line of a multi-row header, where an empty name is shown as a space."""
    return table_line(F.transform(columns, lambda c: F.when(c == "", " ").otherwise(c)))


def rule_line(n_cols: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n_cols), " | "), F.lit(" |"))


def title_lines(table_name: Column) -> Column:
    """Title, then an empty line; only the empty line when the table has no name."""
    return F.when(table_name.isNull() | (table_name == ""), "").otherwise(
        F.concat(F.lit("### Table: "), table_name, F.lit("\n"))
    )


def table_head(table_name: Column, columns: Column) -> Column:
    """Everything above the body: title, header and rule."""
    return F.concat_ws("\n", title_lines(table_name), header_line(columns), rule_line(F.size(columns)))


def table_head_multi(table_name: Column, header_rows: Column) -> Column:
    """As ``table_head`` for a header of several rows (ARRAY<ARRAY<STRING>>)."""
    lines = F.array_join(F.transform(header_rows, blank_safe_header_line), "\n")
    return F.concat_ws("\n", title_lines(table_name), lines, rule_line(F.size(F.get(header_rows, F.lit(0)))))


def split_line(line: Column) -> Column:
    """Cells of one Markdown line; all outer pipes are dropped, so empty edge cells are too."""
    return F.transform(F.split(F.btrim(line, F.lit("|")), r"[|]"), lambda c: F.trim(c))


def parse_table(markdown: Column) -> Column:
    """Markdown text to struct(columns, rows).

    The second line is the rule and is skipped; rows that do not have the
    header's arity are left out; text of fewer than two lines has no table.
    """
    def table_of(lines: Column) -> Column:
        columns = split_line(F.get(lines, F.lit(0)))
        body = F.transform(F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0))), split_line)
        return bind(columns, lambda cs: F.struct(cs.alias("columns"), F.filter(body, lambda r: F.size(r) == F.size(cs)).alias("rows")))

    none = F.struct(F.array().cast("array<string>").alias("columns"), F.array().cast("array<array<string>>").alias("rows"))
    lines = F.split(F.regexp_replace(markdown, r"^\s+|\s+$", ""), "\n")
    return bind(lines, lambda ls: F.when(F.size(ls) >= 2, table_of(ls)).otherwise(none))
