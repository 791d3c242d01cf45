"""Rows to sentences: whole tables with a description column, or part of the rows as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableviews.functions.binding import bind
from tableviews.functions.cells import NAN_TEXT
from tableviews.functions.hashing import stable_hash
from tableviews.functions.text import fill_template
from tableviews.operators.ordering import fraction_bounds, spread_join, within_bound
from tableviews.operators.reshape import cells_at, complete_in, in_slices, positions_in, without_positions
from tableviews.schema import ROWS_PER_PART, ROWS_PER_SLICE, SLICE, TABLE_KEY
from tableviews.session import stored

SEED = 42
TABLES_PER_BLOCK = 100
ROW_RATIO = 0.5

# Status of a table after verbalization.
VERBALIZED = "verbalized"
NO_TEMPLATE = "no_template"
ALL_NULL = "all_null"
RATIO_EMPTY = "ratio_takes_none"
DESCRIPTION = "_description"


def contained(inner: Column, outer: Column) -> Column:
    """Whether every element of ``inner`` occurs in ``outer``."""
    return F.size(F.array_except(inner, outer)) == 0


def choose_template_sets(tables: DataFrame, sets: DataFrame, seed: int = SEED) -> DataFrame:
    """Give every table one of its template sets, chosen by hash.

    A set fits when all its columns occur in the table.  The candidates of one
    (db, table) are gathered first (a handful of sets per table name) and each table
    picks inside its own row, so nothing is shuffled per candidate.  Tables without a
    fitting set keep NULL.
    """
    candidates = sets.groupBy("db", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("set_no", F.col("columns").alias("names"), "templates"))).alias("__sets")
    )
    joined = spread_join(tables, candidates, ["db", "table_name"], TABLE_KEY, "left")
    draw = lambda fit: F.pmod(stable_hash(seed, "sample_id", "table_pos"), F.greatest(F.size(fit), F.lit(1))).cast("int")
    picked = bind(
        F.filter("__sets", lambda s: contained(s["names"], F.col("columns"))), lambda fit: F.slice(fit, draw(fit) + 1, F.lit(1))
    )
    # a slice of one set or none: as rows, so that later filters do not make the choice again
    return joined.select(*tables.columns, F.explode_outer(picked).alias("__set")).select(
        *tables.columns,
        F.col("__set.set_no").alias("set_no"),
        F.col("__set.names").alias("set_columns"),
        F.col("__set.templates").alias("templates"),
        positions_in(F.col("columns"), F.col("__set.names")).alias("set_positions"),
    )


def complete_rows(rows: DataFrame, chosen: DataFrame, *fields: str) -> DataFrame:
    """Rows of verbalized tables that have a value in every column of the set (the raw version)."""
    return _complete_in_slices(rows, chosen, *fields).drop(SLICE)


def _complete_in_slices(rows: DataFrame, chosen: DataFrame, *fields: str) -> DataFrame:
    needed = dict.fromkeys(["set_columns", "templates", "set_positions", *fields])
    with_sets = in_slices(rows, chosen.filter(F.col("set_columns").isNotNull()), *needed)
    return with_sets.filter(complete_in(F.col("set_positions"), F.col("cells")))


def sentence(seed: int = SEED, missing: str = "keep") -> Column:
    """One sentence per row from a template chosen by hash."""
    draw = F.pmod(stable_hash(seed, "sample_id", "table_pos", "row_pos"), F.size("templates"))
    template = F.get("templates", draw.cast("int"))
    return fill_template(template, F.col("set_columns"), cells_at(F.col("set_positions"), F.col("cells")), missing)


def describe_rows(rows: DataFrame, chosen: DataFrame, seed: int = SEED) -> DataFrame:
    """Every complete row with ``description`` and without the described cells (the semi-structured version)."""
    complete = complete_rows(rows, chosen).withColumn("description", sentence(seed))
    return complete.withColumn("cells", without_positions(F.col("set_positions"), F.col("cells"))).select(
        *TABLE_KEY, "row_pos", "n_rows", "cells", "description"
    )


def described_headers(chosen: DataFrame) -> DataFrame:
    """Headers that go with ``describe_rows``."""
    rest = without_positions(F.col("set_positions"), F.col("columns"))
    return chosen.withColumn(
        "columns", F.when(F.col("set_columns").isNull(), F.col("columns")).otherwise(F.concat(rest, F.array(F.lit(DESCRIPTION))))
    ).withColumn("n_cols", F.size("columns"))


def told_rows(rows: DataFrame, chosen: DataFrame, ratio: float = ROW_RATIO, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """Complete rows with their sentence, stored once, and ``taken`` where the table has no more than one slice.

    Rows meet their set once and are stored without the templates.  A slice lies together after this join, so the share of
    a table of one slice is settled there, and its other rows keep no sentence.  Rows of longer tables keep their hash, and
    ``taken`` is open.
    """
    told = _complete_in_slices(rows, chosen).withColumns(
        {"__h": stable_hash(seed, "sample_id", "table_pos", "row_pos"), "description": sentence(seed, missing="mark")}
    ).drop("set_columns", "templates", "set_positions")
    ordered = Window.partitionBy(*TABLE_KEY, SLICE).orderBy("__h", "row_pos")
    n = F.count("*").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    goal = F.floor(n * F.lit(ratio))
    # rows that are equal in hash and place are taken together, as up to a bound
    settled = told.withColumn("taken", F.when(F.col("n_rows") <= ROWS_PER_SLICE, (F.rank().over(ordered) <= goal) & (goal < n)))
    kept = settled.withColumns(
        {"__h": F.when(F.col("taken").isNull(), F.col("__h")), "description": F.when(F.coalesce("taken", F.lit(True)), F.col("description"))}
    )
    return stored(kept.drop(SLICE), folder, "zstd")


def long_table_bounds(told: DataFrame, ratio: float = ROW_RATIO) -> DataFrame:
    """The bounds of the shares of tables of several slices, settled on ids and hashes; one row for each such table."""
    return fraction_bounds(told.filter("taken IS NULL"), TABLE_KEY, ratio, F.col("__h"), "row_pos")


def taken_rows(told: DataFrame, bounds: DataFrame) -> DataFrame:
    """``told_rows`` with ``taken`` for all tables.  Each bound stands for more rows than a slice has, so bounds are broadcast."""
    taken = F.coalesce("taken", within_bound(F.col("__h"), F.col("row_pos")))
    marked = told.join(F.broadcast(bounds), TABLE_KEY, "left").withColumn("taken", taken)
    return marked.withColumn("description", F.when(F.col("taken"), F.col("description"))).drop("last_h", "last_tie", "__h")


def split_rows(rows: DataFrame, chosen: DataFrame, ratio: float = ROW_RATIO, seed: int = SEED, folder: str | None = None) -> DataFrame:
    """Complete rows with ``taken``: exactly the given share per table becomes text.

    Taken rows get a ``description``; the other rows keep all their cells.  No stored row is shuffled again.
    """
    told = told_rows(rows, chosen, ratio, seed, folder)
    return taken_rows(told, long_table_bounds(told, ratio))


def text_parts(df: DataFrame, keys: list[str], text: str, separator: str = " ", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Texts of a group joined in row order, as (keys, part, body).

    ``row_pos`` is dense, so the part is computed from it alone: a table of up to
    ``rows_per_part`` rows gives part 0 only, a longer one a text per part.
    """
    part = F.floor(F.col("row_pos") / F.lit(rows_per_part)).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("row_pos", text)))
    return df.withColumn("part", part).groupBy(*keys, "part").agg(
        F.array_join(F.transform(ordered, lambda r: r[text]), separator).alias("body")
    )


def paragraphs(described: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Sentences of each table joined by a space, as (sample_id, table_pos, part, body)."""
    told = described.filter(F.col("description").isNotNull())
    return text_parts(told, TABLE_KEY, "description", " ", rows_per_part)


def text_segments(parts: DataFrame) -> DataFrame:
    """Non-blank paragraphs as segments in table order, as (sample_id, table_pos, part, text)."""
    return parts.filter(F.trim("body") != "").select(*TABLE_KEY, "part", F.trim("body").alias("text"))


def nested_segments(parts: DataFrame) -> DataFrame:
    """Segments as ``verbalized_data``, as (sample_id, table_block, part, verbalized_data).

    A usual sample has one row, with block and part 0.  Further rows continue samples of
    very many tables or very long ones.
    """
    block = F.floor(F.col("table_pos") / F.lit(TABLES_PER_BLOCK)).cast("bigint")
    listed = F.array_sort(F.collect_list(F.struct("table_pos", "text")))
    return text_segments(parts).withColumn("table_block", block).groupBy("sample_id", "table_block", "part").agg(
        F.transform(listed, lambda s: F.struct(s["text"].alias("text"))).alias("verbalized_data")
    )


def samples_with_text(samples: DataFrame, parts: DataFrame) -> DataFrame:
    """Samples of which some table has a paragraph."""
    told = parts.filter(F.trim("body") != "").select("sample_id").distinct()
    return samples.join(told, "sample_id", "left_semi")


def used_columns(chosen: DataFrame) -> DataFrame:
    """Per sample a map of table name to the sorted described columns."""
    used = chosen.filter(F.col("set_columns").isNotNull())
    # equal names inside one sample: the later table wins
    last = used.groupBy("sample_id", "table_name").agg(
        F.max_by(F.array_sort("set_columns"), "table_pos").alias("used")
    )
    entries = F.array_sort(F.collect_list(F.struct("table_name", "used")))
    return last.groupBy("sample_id").agg(F.map_from_entries(entries).alias("used_keys"))


def table_status(chosen: DataFrame, described: DataFrame) -> DataFrame:
    """What became of each table: verbalized, no template, only incomplete rows, or nothing taken."""
    counts = described.groupBy(*TABLE_KEY).agg(
        F.count("*").alias("n_complete"), F.count("description").alias("n_described")
    )
    joined = chosen.join(counts, TABLE_KEY, "left")
    status = (
        F.when(F.col("set_columns").isNull(), NO_TEMPLATE)
        .when(F.col("n_complete").isNull(), ALL_NULL)
        .when(F.col("n_described") == 0, RATIO_EMPTY)
        .otherwise(VERBALIZED)
    )
    return joined.withColumn("status", status)


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("count"))


def answer_ok(flat: Column) -> Column:
    """Whether an answer may be kept: not empty and no missing cell."""
    return F.coalesce((F.size(flat) > 0) & F.forall(flat, lambda x: x.isNotNull() & (x != NAN_TEXT)), F.lit(False))


def gate_by_answer(samples: DataFrame, flat: str) -> DataFrame:
    """Add ``ok``; the caller writes ``ok`` and ``NOT ok`` to two sinks."""
    return samples.withColumn("ok", answer_ok(F.col(flat)))
