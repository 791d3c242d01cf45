"""Corpora of records: one VARIANT per record with its place in the input."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tableviews.session import spread, stored
from tableviews.sources.pieces import Format, read_records

# Places of one split end here, so the places of several splits never meet.
SPLIT_PLACES = 1 << 40


_ESCAPED = re.compile(r"\\.", re.DOTALL)


def _json_piece(value: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """What a piece of JSON, with the brace behind it, does to an open string and to the depth of brackets."""
    plain = value + "}"
    if "\\" in plain:
        plain = _ESCAPED.sub("", plain)
    parts = plain.split('"')
    depth = [sum(t.count("{") + t.count("[") - t.count("}") - t.count("]") for t in parts[s::2]) for s in (0, 1)]
    odd = 1 - len(parts) % 2
    return (odd, depth[0]), (1 - odd, depth[1])


# a record ends at a brace that leaves only the list open; the brace reckoned behind the closing bracket closes nothing
JSON_LIST = Format("}", _json_piece, depth=1, keep_separator=True, last_depth=-1)


def read_json_array(spark: SparkSession, path: str, partitions: int | None = None, block_bytes: int | None = None) -> DataFrame:
    """Files that hold one list of records each, as (ord, record); ``partitions`` deals the records out.

    A file is read by as many tasks as it has blocks of ``block_bytes`` (Spark's own size by default), see
    `tableviews.sources.pieces`; its records are stored once.  ord goes on from file to file.  A file that is no list of
    JSON objects is an error; Spark passes over files without a byte.
    """
    no_list = lambda file: f"{file} holds no JSON list"
    found = read_records(spark, path, JSON_LIST, no_list, block_bytes)
    ends = F.when(F.col("nr") == 0, F.col("text").rlike(r"\A\s*\[\s*\]\s*\z")).otherwise(F.col("text").rlike(r"\A\s*\]\s*\z"))
    # one row for each file
    bad = found.filter("rest").filter(~ends).select("file").first()
    if bad:
        raise ValueError(no_list(bad["file"]))
    begins = F.when(F.col("nr") == 0, F.col("text").rlike(r"\A\s*\[\s*\{")).otherwise(F.col("text").rlike(r"\A\s*,\s*\{"))
    parsed = F.when(begins, F.from_json(F.expr("substring(text, instr(text, '{'))"), "variant"))
    message = F.concat("file", F.lit(" holds no JSON list of objects: record "), F.col("nr").cast("string"))
    # conditions on the record may be put before the filter, so what stands behind the last record is no error there
    listed = found.filter("NOT rest").select("ord", "nr", "file", "rest", parsed.alias("record"))
    lost = F.col("record").isNull() & ~F.col("rest")
    whole = listed.select("ord", F.when(lost, F.raise_error(message).cast("variant")).otherwise(F.col("record")).alias("record"))
    return spread(whole, partitions) if partitions else whole


def read_json_lines(spark: SparkSession, path: str, rejected: str = "fail") -> DataFrame:
    """One record per line, as (ord, record).  NaN and infinities are numbers, empty lines are no records.

    ``rejected`` says what becomes of a line that is no JSON: ``fail`` ends the job with an
    error; ``rows`` keeps it, with ``record`` NULL and its text in a third column ``rejected``.

    ``ord`` follows file name, place of the split in the file, and line.  Only the line
    counts of the splits are accumulated, in one task (a row for each file split); the lines
    get the offset of their split by a join with that short list and are not sorted or moved.
    """
    if rejected not in ("fail", "rows"):
        raise ValueError("rejected must be fail or rows")
    lines = spark.read.text(path).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__line"),
        "value",
    )
    splits = lines.groupBy("__file", "__start").agg(F.min("__line").alias("__first"), F.count("*").alias("__n"))
    in_order = Window.partitionBy(F.lit(0)).orderBy("__file", "__start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__file", "__start", "__first", F.coalesce(F.sum("__n").over(in_order), F.lit(0)).alias("__before"))
    placed = lines.join(offsets, ["__file", "__start"])
    parsed = placed.select(
        (F.col("__before") + F.col("__line") - F.col("__first")).alias("ord"), F.from_json("value", "variant").alias("record"), "value"
    )
    lost = F.col("record").isNull()
    if rejected == "rows":
        return parsed.select("ord", "record", F.when(lost, F.col("value")).alias("rejected"))
    message = F.concat(F.lit("line "), F.col("ord").cast("string"), F.lit(" is no JSON: "), F.substring("value", 1, 80))
    return parsed.select("ord", F.when(lost, F.raise_error(message).cast("variant")).otherwise(F.col("record")).alias("record"))


def read_splits(spark: SparkSession, paths: Mapping[str, str], lines: bool = False) -> DataFrame:
    """Several splits of a corpus in one DataFrame with ``split``; ``ord`` goes on from split to split."""
    reader = read_json_lines if lines else read_json_array
    parts = [
        reader(spark, path).withColumns({"split": F.lit(name), "ord": F.col("ord") + F.lit(k * SPLIT_PLACES)})
        for k, (name, path) in enumerate(paths.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_questions(spark: SparkSession, paths: Mapping[str, str], lines: bool = False) -> DataFrame:
    """Question files of several splits, as the ``samples`` of a table catalog."""
    records = read_splits(spark, paths, lines)
    get = lambda p: F.try_variant_get("record", p, "string")
    return records.select(
        F.concat_ws("_", "split", F.coalesce(get("$.question_id"), (F.col("ord") % SPLIT_PLACES).cast("string"))).alias("sample_id"),
        "ord",
        "split",
        get("$.db_id").alias("db"),
        get("$.question").alias("question"),
        get("$.SQL").alias("sql"),
        F.coalesce(get("$.difficulty"), F.lit("unknown")).alias("difficulty"),
    )


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines in a directory, written by all tasks and committed as one."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, order_by: str, mode: str = "errorifexists") -> None:
    """One list in one file, a record a line, for readers that want it so.

    The records are made by all tasks and stored as packed lines; one task puts them in order and writes them, a row at a time.
    """
    made = stored(df.select(order_by, F.to_json(F.struct(*df.drop(order_by).columns)).alias("value")), compression="zstd")
    first = made.agg(F.min(order_by)).first()[0]
    lines = made.select(F.lit(1).alias("part"), order_by, F.concat(F.when(F.col(order_by) != first, ",").otherwise(""), "value").alias("value"))
    kind = dict(df.dtypes)[order_by]
    for part, bracket in ((0, "["), (2, "]")):
        lines = lines.unionByName(df.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(None).cast(kind).alias(order_by), F.lit(bracket).alias("value")))
    lines.coalesce(1).sortWithinPartitions("part", order_by).select("value").write.mode(mode).text(path)


def write_normalized(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """The normalized tables as Parquet below one path."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def write_gated(df: DataFrame, flag: str, path: str, mode: str = "errorifexists") -> None:
    """Kept and failed records side by side, told apart by the partition column."""
    df.withColumn("outcome", F.when(F.col(flag), "kept").otherwise("failed")).write.mode(mode).partitionBy("outcome").json(path)
