"""CSV tables between steps, catalog tables, database metadata and prompt files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableviews.functions.replies import parse_list_field
from tableviews.functions.text import percent_text
from tableviews.operators.ordering import number_rows
from tableviews.operators.reshape import nested_content
from tableviews.sources.pieces import Format, read_records

META_DDL = (
    "db_id string, table_names_original array<string>, column_names_original array<array<string>>, "
    "primary_keys variant, foreign_keys variant"
)


# a line that ends inside a quoted cell: whole cells, then one that is not closed; a doubled quote closes nothing
_OPEN_LINE = re.compile(r'(?>(?>"(?>[^"]++|"")*+"[^,]*+|[^",][^,]*+)?,)*+"(?>[^"]++|"")*+')


def _csv_line(line: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """Whether a line leaves a quoted cell open, for both ways it may begin."""
    if '"' not in line:
        return (0, 0), (1, 0)
    return (int(bool(_OPEN_LINE.fullmatch(line))), 0), (int(bool(_OPEN_LINE.fullmatch('"' + line))), 0)


CSV = Format("\n", _csv_line, depth=0, keep_separator=False, last_depth=0)


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, block_bytes: int | None = None) -> DataFrame:
    """CSV with a header in every file; cells may hold line breaks and doubled quotes.

    A file is read by as many tasks as it has blocks of ``block_bytes`` (Spark's own size by default), see
    `tableviews.sources.pieces`; its rows are stored once.  A line break inside a cell stays as it is written.  A file that
    ends inside a quoted cell is an error.  With ``multi_line`` off, cells hold no line breaks and nothing is stored.
    """
    options = {"quote": '"', "escape": '"'}
    plain = spark.read.options(header=True, multiLine=multi_line, **options).csv(path)
    if not multi_line or not plain.columns:
        return plain
    found = read_records(spark, path, CSV, lambda file: f"{file} ends inside a quoted cell", block_bytes)
    line = F.when(F.col("text").endswith("\r"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in plain.columns)
    rows = found.filter("NOT rest AND nr > 0").select(line.alias("line")).filter("line != ''")
    return rows.select(F.from_csv("line", schema, options).alias("row")).select("row.*")


def write_csv(df: DataFrame, path: str, order_by: Sequence[str | Column], mode: str = "errorifexists") -> None:
    """Sorted CSV.  Arrays become comma-separated text and maps JSON, as people read them."""
    plain = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "array":
            plain[field.name] = F.array_join(field.name, ", ")
        elif kind in ("map", "struct"):
            plain[field.name] = F.to_json(field.name)
    text = df.orderBy(*order_by).withColumns(plain) if plain else df.orderBy(*order_by)
    text.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """A usage profile from CSV, with lists and maps restored."""
    raw = read_csv(spark, path)
    lists = {c: parse_list_field(F.coalesce(F.col(c), F.lit(""))) for c in raw.columns if c.endswith("_columns")}
    examples = F.coalesce(F.from_json("column_examples", "map<string,array<string>>"), F.create_map().cast("map<string,array<string>>"))
    named = raw.withColumnRenamed("table", "table_name") if "table" in raw.columns else raw
    return named.withColumns(lists | ({"column_examples": examples} if "column_examples" in raw.columns else {}))


def printable_profile(profile: DataFrame) -> DataFrame:
    """Profile with its share as percent text, for the CSV sink."""
    return profile.withColumn("match_rate", percent_text(F.col("match_rate"))).withColumnRenamed("table_name", "table")


def read_metadata(spark: SparkSession, paths: Mapping[str, str], lines: bool = False) -> DataFrame:
    """Database metadata: names, ordered columns with their table index, keys.

    A file is one list of databases, or one database a line with ``lines``.  Text that is no JSON is an error.
    """
    reader = spark.read.schema(META_DDL).option("multiLine", not lines).option("mode", "FAILFAST")
    parts = [reader.json(path) for path in paths.values()]
    raw = parts[0]
    for part in parts[1:]:
        raw = raw.unionByName(part)
    columns = F.transform(
        "column_names_original", lambda c: F.struct(F.get(c, F.lit(0)).try_cast("int").alias("t_idx"), F.get(c, F.lit(1)).alias("column"))
    )
    return raw.select(
        F.col("db_id").alias("db"),
        F.col("table_names_original").alias("table_names"),
        columns.alias("column_names"),
        F.to_json("primary_keys").alias("primary_keys"),
        F.to_json("foreign_keys").alias("foreign_keys"),
    )


def table_as_rows(
    df: DataFrame, db: str, table_name: str, order: Sequence[str], split_by: Sequence[Column]
) -> DataFrame:
    """A catalog table as (db, table_name, row_pos, n_rows, cells, vtypes)."""
    kinds = [_cell_type(f.dataType.typeName()) for f in df.schema.fields]
    texts = [F.col(c).cast("string") for c in df.columns]
    keyed = df.select(
        F.lit(db).alias("db"), F.lit(table_name).alias("table_name"), *df.columns, F.array(*texts).alias("cells"),
        F.array(*[F.when(F.col(c).isNull(), "VOID").otherwise(k) for c, k in zip(df.columns, kinds)]).alias("vtypes"),
    )
    return number_rows(keyed, ["db", "table_name"], order, split_by).select(
        "db", "table_name", "row_pos", "n_rows", "cells", "vtypes"
    )


def _cell_type(kind: str) -> str:
    if kind in ("byte", "short", "integer", "long"):
        return "BIGINT"
    if kind in ("float", "double", "decimal"):
        return "DOUBLE"
    return "BOOLEAN" if kind == "boolean" else "STRING"


def read_catalog(spark: SparkSession, paths: Mapping[tuple[str, str], str]) -> dict[tuple[str, str], DataFrame]:
    """Parquet tables of a catalog by (db, table)."""
    return {key: spark.read.parquet(path) for key, path in paths.items()}


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """A prompt file as one row (template); join it to the rows that are to be filled."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("template"))


def read_prompt_variants(spark: SparkSession, path: str) -> DataFrame:
    """All prompt files below a path, as (variant, template)."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("variant"), F.col("value").alias("template"))


def nested_tables(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """Tables in record form, as (sample_id, table_pos, part, table_name, table_columns, table_content)."""
    return nested_content(rows).join(
        tables.select("sample_id", "table_pos", "table_name", F.col("columns").alias("table_columns")), ["sample_id", "table_pos"], "right"
    )
