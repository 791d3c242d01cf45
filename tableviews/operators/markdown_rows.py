"""Rows of Markdown tables that come in numbered parts, read part by part.

A table is never put together in one cell: the header, the rule behind it and the edges of the text are found from one
short row for each part, and every part turns its own lines into rows with the table's header beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableviews.functions.markdown import split_line


def _filled(line: Column) -> Column:
    return line.rlike(r"\S")


def markdown_rows(parts: DataFrame, key: str = "table_id") -> DataFrame:
    """(key, columns, row_pos, n_rows, cells) of tables given as (key, part, markdown), and ``ord`` if versions of a key differ.

    It says the same as `functions.markdown.parse_table` on the parts joined by line breaks: blank lines at both ends are
    left out, the second line is the rule, rows of another arity than the header's are left out, and a text of fewer than
    two lines has no rows.  Of several versions the one with the largest ``ord`` counts.  Parts follow their numbers, which
    may have gaps.  NULL text is empty.  ``row_pos`` is dense.
    """
    if "ord" in parts.columns:
        last = parts.groupBy(key).agg(F.max("ord").alias("ord"))
        parts = parts.join(last, [key, "ord"])
    lined = parts.select(key, "part", F.split(F.coalesce("markdown", F.lit("")), "\n").alias("lines"))
    numbered = F.filter(F.transform("lines", lambda line, i: F.when(_filled(line), i)), lambda i: i.isNotNull())
    # one row for each part: where its text begins and ends, and its first line if a table's text begins here
    edges = lined.select(key, "part", F.size("lines").alias("n_lines"), F.array_min(numbered).alias("first"), F.array_max(numbered).alias("last"), F.get("lines", F.array_min(numbered)).alias("head"))
    following = edges.withColumn("next_part", F.lead("part").over(Window.partitionBy(key).orderBy("part")))
    told = F.col("first").isNotNull()
    tables = following.groupBy(key).agg(
        F.min(F.when(told, F.struct("part", "first", "n_lines", "next_part", "head"))).alias("begin"),
        F.max(F.when(told, F.struct("part", "last"))).alias("end"),
    )
    # the rule is the line behind the header, which may be the first one of the next part; rows follow it
    inside = F.col("begin.first") + 1 < F.col("begin.n_lines")
    heads = tables.filter("begin IS NOT NULL").select(
        key,
        # the edge of the whole text is trimmed, so blanks before its first line are none of its cells
        split_line(F.regexp_replace("begin.head", r"^\s+", "")).alias("columns"),
        F.when(inside, F.col("begin.part")).otherwise(F.col("begin.next_part")).alias("rule_part"),
        F.when(inside, F.col("begin.first") + 1).otherwise(0).alias("rule_line"),
        F.col("end.part").alias("end_part"),
        F.col("end.last").alias("end_line"),
    )
    # the rule has to lie within the text
    heads = heads.filter(F.struct("rule_part", "rule_line") <= F.struct("end_part", "end_line"))
    met = lined.join(heads, key).filter("part >= rule_part AND part <= end_part")
    begin = F.when(F.col("part") == F.col("rule_part"), F.col("rule_line") + 1).otherwise(0)
    stop = F.when(F.col("part") == F.col("end_part"), F.col("end_line") + 1).otherwise(F.size("lines"))
    at_end = lambda i: (F.col("part") == F.col("end_part")) & (i == F.col("end_line"))
    cells = F.transform(
        F.filter(F.transform("lines", lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda x: (x["i"] >= begin) & (x["i"] < stop)),
        lambda x: split_line(F.when(at_end(x["i"]), F.regexp_replace(x["line"], r"\s+$", "")).otherwise(x["line"])),
    )
    read = met.select(key, "part", "columns", F.filter(cells, lambda row: F.size(row) == F.size("columns")).alias("rows"))
    counts = read.select(key, "part", F.size("rows").cast("bigint").alias("n"))
    by_part = Window.partitionBy(key).orderBy("part")
    places = counts.select(
        key, "part",
        F.coalesce(F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"),
    )
    exploded = read.join(places, [key, "part"]).select(key, "columns", "before", "n_rows", F.posexplode("rows").alias("i", "cells"))
    return exploded.select(key, "columns", (F.col("before") + F.col("i")).alias("row_pos"), "n_rows", "cells")
