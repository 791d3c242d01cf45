"""Markdown tables read part by part, against the whole text parsed at once."""

import random

from pyspark.sql import functions as F

from tableviews.functions.markdown import parse_table
from tableviews.operators.markdown_rows import markdown_rows


def whole(spark, texts):
    frame = spark.createDataFrame(list(texts.items()), "table_id string, markdown string")
    parsed = frame.select("table_id", parse_table(F.coalesce("markdown", F.lit(""))).alias("t"))
    return {(r.table_id, k): (r.t.columns, len(r.t.rows), row) for r in parsed.collect() for k, row in enumerate(r.t.rows)}


def by_parts(df):
    rows = df.collect()
    assert len({(r.table_id, r.row_pos) for r in rows}) == len(rows)
    return {(r.table_id, r.row_pos): (r.columns, r.n_rows, r.cells) for r in rows}


def test_parts_say_what_the_whole_text_says(spark):
    draw = random.Random(6)
    lines = ["| a | b |", "| --- | --- |", "| 1 | 2 |", "|3|4|", "x | y", "", "  ", "| 1 |", "| 1 | 2 | 3 |", "  | p | q |  ", "||", "a"]
    texts, parts = {}, []
    for t in range(300):
        name = f"t{t}"
        pieces = ["\n".join(draw.choices(lines, k=draw.randrange(0, 6))) for _ in range(draw.randrange(1, 5))]
        texts[name] = "\n".join(pieces)
        number = 0
        for piece in pieces:
            parts.append((name, number, piece))
            number += draw.choice([1, 1, 3])
    draw.shuffle(parts)
    frame = spark.createDataFrame(parts, "table_id string, part int, markdown string").repartition(5)
    wanted = whole(spark, texts)
    assert len(wanted) > 300 and by_parts(markdown_rows(frame)) == wanted


def test_the_last_version_counts_and_nulls_are_empty(spark):
    parts = [("a", 1, 0, "|x|\n|-|\n|old|"), ("a", 2, 0, "|y|"), ("a", 2, 1, "|-|"), ("a", 2, 2, "|new|"), ("b", 0, 0, None), ("c", 0, 0, "|x|"), ("c", 0, 1, None)]
    got = by_parts(markdown_rows(spark.createDataFrame(parts, "table_id string, ord int, part int, markdown string")))
    assert got == {("a", 0): (["y"], 1, ["new"])}
    assert markdown_rows(spark.createDataFrame([], "table_id string, part int, markdown string")).count() == 0


def test_a_long_table_is_not_put_together(spark):
    n = 25_000
    body = spark.range(n).selectExpr("'t' AS table_id", "id DIV 1000 + 1 AS part", "id", "concat('| ', id, ' | v', id, ' |') AS line")
    pieces = body.groupBy("table_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("markdown"))
    head = spark.createDataFrame([("t", 0, "| k | v |\n| --- | --- |")], "table_id string, part long, markdown string")
    rows = markdown_rows(pieces.unionByName(head))
    checked = rows.agg(F.count("*").alias("n"), F.count_if((F.get("cells", F.lit(0)).cast("long") == F.col("row_pos")) & (F.col("n_rows") == n)).alias("right")).first()
    assert (checked.n, checked.right) == (n, n)
