"""Which columns the queries use, what the columns hold, how big the tables are."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from tableviews.functions.cells import voted_sql_type
from tableviews.functions.text import column_mentioned
from tableviews.operators.ordering import top_per_group
from tableviews.operators.reshape import with_tables
from tableviews.schema import TABLE_KEY

N_EXAMPLES = 3
HIGH_SHARE = 0.5


def _table_key(by_name: bool) -> list[str]:
    return ["table_name"] if by_name else ["db", "table_name"]


def column_mentions(tables: DataFrame, word: bool = False) -> DataFrame:
    """One row per sample, table and column with ``mentioned``."""
    exploded = tables.select(
        *TABLE_KEY, "ord", "db", "table_name", "sql", F.posexplode("columns").alias("col_pos", "column")
    )
    return exploded.withColumn("mentioned", column_mentioned(F.col("sql"), F.col("column"), word)).drop("sql")


# A column that is one word of ASCII letters, digits and underscores is met as a word; others are looked for by pattern.
ONE_WORD = r"\A[A-Za-z0-9_]+\z"


def column_counts(tables: DataFrame, word: bool = False, by_name: bool = False) -> DataFrame:
    """Per table and column: occurrences, uses, and the database seen last.

    Only numbers are combined inside the tasks, which needs no sort; databases are compared after that, on one row for
    each column of a table in a database.
    """
    if word:
        return _column_stats_by_words(tables, by_name).drop("first_seen", "first_at")
    counted = column_mentions(tables).groupBy("db", "table_name", "column").agg(
        F.count("*").alias("total"), F.count_if("mentioned").alias("matched"), F.max("ord").alias("last_ord")
    )
    return counted.groupBy(*_table_key(by_name), "column").agg(
        F.sum("total").alias("total"),
        F.sum("matched").alias("matched"),
        F.max_by("db", "last_ord").alias("last_db"),
        F.max("last_ord").alias("last_ord"),
    )


def first_places(tables: DataFrame, by_name: bool = False) -> DataFrame:
    """Per table and column where it was first seen, as (keys, column, first_seen, first_at).

    The first table of each different header is found before columns are listed.
    """
    keys = _table_key(by_name)
    firsts = tables.groupBy(*keys, "columns").agg(F.min(F.struct("ord", "table_pos", "sample_id")).alias("first"))
    listed = firsts.select(*keys, "first", F.posexplode("columns").alias("col_pos", "column"))
    place = F.struct("first.ord", "first.table_pos")
    seen = F.struct(F.col("first.sample_id").alias("sample_id"), F.col("first.table_pos").alias("table_pos"), "col_pos")
    return listed.groupBy(*keys, "column").agg(F.min_by(seen, place).alias("first_seen"), F.min(place).alias("first_at"))


def column_stats(tables: DataFrame, word: bool = False, by_name: bool = False) -> DataFrame:
    """Per table and column: occurrences, uses, and where the column was first seen.

    Sums and minima are combined inside the tasks before the shuffle, so a table
    that most samples share costs no more than any other.
    """
    if word:
        return _column_stats_by_words(tables, by_name)
    keys = [*_table_key(by_name), "column"]
    firsts = first_places(tables, by_name).withColumnsRenamed({c: f"__{c}" for c in keys})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys])
    return column_counts(tables, by_name=by_name).join(firsts, same).drop(*[f"__{c}" for c in keys])


def _column_stats_by_words(tables: DataFrame, by_name: bool) -> DataFrame:
    """`column_stats` for whole words: the words of the SQL texts meet the column names by an equi-join.

    Headers that are equal are counted once, so columns are listed for each different header and words for each text,
    and no text is searched for every column.  Names of several words, or with other characters, are searched.
    """
    keys = list(dict.fromkeys([*_table_key(by_name), "db", "table_name"]))
    headed = tables.withColumn("header", F.md5(F.to_json(F.struct("columns")))).select(*TABLE_KEY, "ord", "db", "table_name", "header", "sql", "columns")
    headers = headed.groupBy("db", "table_name", "header").agg(
        F.any_value("columns").alias("columns"),
        F.count("*").alias("total"),
        F.max("ord").alias("last_ord"),
        F.min(F.struct("ord", "table_pos", "sample_id")).alias("first"),
    )
    listed = headers.select("db", "table_name", "header", "total", "last_ord", "first", F.posexplode("columns").alias("col_pos", "column"))
    counted = listed.groupBy(*_table_key(by_name), "column").agg(
        F.sum("total").alias("total"),
        F.max_by("db", "last_ord").alias("last_db"),
        F.max("last_ord").alias("last_ord"),
        F.min_by(F.struct(F.col("first.sample_id").alias("sample_id"), F.col("first.table_pos").alias("table_pos"), "col_pos"), F.struct("first.ord", "first.table_pos")).alias("first_seen"),
        F.min(F.struct("first.ord", "first.table_pos")).alias("first_at"),
    )
    # one row for each different word of a text
    words = headed.select("db", "table_name", "header", F.explode(F.array_distinct(F.split(F.lower("sql"), "[^a-z0-9_]+"))).alias("word"))
    said = words.filter("word != ''").groupBy("db", "table_name", "header", "word").agg(F.count("*").alias("n"))
    place = listed.select("db", "table_name", "header", "column")
    simple = F.col("column").rlike(ONE_WORD)
    by_word = place.filter(simple).withColumn("word", F.lower("column")).join(said, ["db", "table_name", "header", "word"])
    odd = place.filter(~simple).distinct().join(headed.select("db", "table_name", "header", "sql"), ["db", "table_name", "header"])
    by_pattern = odd.filter(column_mentioned(F.col("sql"), F.col("column"), True))
    # a name that a header repeats counts for each of its places, as in the list of columns
    repeats = place.filter(~simple).groupBy("db", "table_name", "header", "column").agg(F.count("*").alias("n"))
    matched = by_word.select(*keys, "column", "n").unionByName(
        by_pattern.join(repeats, ["db", "table_name", "header", "column"]).select(*keys, "column", "n")
    )
    used = matched.groupBy(*_table_key(by_name), "column").agg(F.sum("n").alias("matched"))
    return counted.join(used, [*_table_key(by_name), "column"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


def merge_stats(parts: DataFrame, by_name: bool = False) -> DataFrame:
    """`column_stats` of several batches of samples, put one below the other, as those of all samples.

    Counts are added, extremes compared; so a new batch costs its own rows, and merging is the same in any order.  The
    batches have to share one numbering ``ord`` of their samples, as the splits of a corpus do.
    """
    return parts.groupBy(*_table_key(by_name), "column").agg(
        F.sum("total").alias("total"),
        F.sum("matched").alias("matched"),
        F.max_by("last_db", "last_ord").alias("last_db"),
        F.max("last_ord").alias("last_ord"),
        F.min_by("first_seen", "first_at").alias("first_seen"),
        F.min("first_at").alias("first_at"),
    )


def merge_counts(parts: DataFrame, *keys: str) -> DataFrame:
    """Counts of several batches, as (keys, count)."""
    return parts.groupBy(*keys).agg(F.sum("count").alias("count"))


def column_usage(tables: DataFrame, word: bool = False, by_name: bool = False) -> DataFrame:
    """Per table: used and unused columns and the share of used ones.

    Tables are told apart by database and name; ``by_name`` merges equal names of
    different databases and reports the database seen last.
    """
    return usage_of(column_counts(tables, word, by_name), by_name)


def usage_of(stats: DataFrame, by_name: bool = False) -> DataFrame:
    """`column_usage` from `column_stats`."""
    keys = _table_key(by_name)
    used, unused = F.col("matched") > 0, F.col("matched") == 0
    grouped = stats.groupBy(*keys).agg(
        F.max_by("last_db", "last_ord").alias("last_db"),
        F.array_sort(F.collect_list(F.when(used, F.col("column")))).alias("matched_columns"),
        F.array_sort(F.collect_list(F.when(unused, F.col("column")))).alias("unmatched_columns"),
    )
    n_used = F.size("matched_columns")
    share = n_used / (n_used + F.size("unmatched_columns"))
    profile = grouped.withColumn("match_rate", share)
    return profile.withColumnRenamed("last_db", "db") if by_name else profile.drop("last_db")


def with_column_less_tables(profile: DataFrame, tables: DataFrame) -> DataFrame:
    """Add tables that never show a column, with empty lists and a share of 0."""
    keys = [c for c in ("db", "table_name") if c in profile.columns]
    missing = tables.select(*keys).distinct().join(profile.select(*keys), keys, "left_anti")
    empty = F.array().cast("array<string>")
    return profile.unionByName(
        missing.select(*keys, empty.alias("matched_columns"), empty.alias("unmatched_columns"), F.lit(0.0).alias("match_rate"))
    )


def high_freq_columns(tables: DataFrame, word: bool = False, by_name: bool = False, share: float = HIGH_SHARE) -> DataFrame:
    """Per table: columns that at least ``share`` of the samples with that column use."""
    return high_freq_of(column_counts(tables, word, by_name), by_name, share)


def high_freq_of(stats: DataFrame, by_name: bool = False, share: float = HIGH_SHARE) -> DataFrame:
    """`high_freq_columns` from `column_stats`."""
    keys = _table_key(by_name)
    high = F.col("matched") / F.col("total") >= share
    grouped = stats.groupBy(*keys).agg(
        F.max_by("last_db", "last_ord").alias("last_db"),
        F.array_sort(F.collect_list(F.when(high, F.col("column")))).alias("high_freq_columns"),
        F.array_sort(F.collect_list(F.when(~high, F.col("column")))).alias("low_freq_columns"),
    )
    n_high = F.size("high_freq_columns")
    profile = grouped.withColumn("match_rate", n_high / (n_high + F.size("low_freq_columns")))
    return profile.withColumnRenamed("last_db", "db") if by_name else profile.drop("last_db")


def table_frequency(table_names: DataFrame) -> DataFrame:
    """Occurrences per table name, from one row per use; most frequent first, ties by name."""
    counted = table_names.groupBy("table_name").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "table_name")


def distinct_tables(table_names: DataFrame) -> DataFrame:
    return table_names.agg(F.count_distinct("table_name").alias("n_tables"))


def first_distinct_values(cells: DataFrame, keys: list[str], k: int = N_EXAMPLES) -> DataFrame:
    """First k distinct non-empty values per key in row order, as (keys, value, row_pos)."""
    filled = cells.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    firsts = filled.groupBy(*keys, "value").agg(F.min("row_pos").alias("row_pos"))
    return top_per_group(firsts, keys, ["row_pos", "value"], k)


def column_examples(rows: DataFrame, tables: DataFrame, retry: bool = False, by_name: bool = False) -> DataFrame:
    """Per table and column the first distinct values of one sample, as ``examples``.

    The sample is the one where the column was seen first; with ``retry`` it is the
    first one where the column holds any value.  Which sample that is comes from a
    minimum per column; only the rows of those samples are looked at for values.
    """
    keys = _table_key(by_name)
    if retry:
        filled = _column_cells(rows, tables.withColumn("picks", F.transform("columns", lambda c, i: F.struct(i.alias("col_pos"), c.alias("column"))))).filter(
            F.col("value").isNotNull() & (F.col("value") != "")
        )
        first = filled.groupBy(*keys, "column").agg(
            F.min_by(F.struct(*TABLE_KEY, "col_pos"), F.struct("ord", "table_pos")).alias("first_seen")
        )
    else:
        first = first_places(tables, by_name)
    picks = (
        first.select(*keys, "column", "first_seen.*")
        .groupBy(*TABLE_KEY)
        .agg(F.collect_list(F.struct("col_pos", "column")).alias("picks"))
    )
    chosen = tables.join(picks, TABLE_KEY)
    values = first_distinct_values(_column_cells(rows, chosen), [*keys, "column"])
    listed = values.groupBy(*keys, "column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_pos", "value"))), lambda v: v["value"]).alias("examples")
    )
    return first.select(*keys, "column").join(listed, [*keys, "column"], "left").withColumn(
        "examples", F.coalesce("examples", F.array().cast("array<string>"))
    )


def _column_cells(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """Cells of the picked columns in long form."""
    headed = with_tables(rows, picked, "db", "ord", "table_name", "picks")
    return headed.select(
        *TABLE_KEY, "row_pos", "ord", "db", "table_name", "cells", F.explode("picks").alias("pick")
    ).select(
        *TABLE_KEY, "row_pos", "ord", "db", "table_name",
        F.col("pick.col_pos").alias("col_pos"), F.col("pick.column").alias("column"),
        F.get("cells", F.col("pick.col_pos")).alias("value"),
    )


def examples_map(examples: DataFrame, by_name: bool = False) -> DataFrame:
    """Examples of all columns of a table as one map, ordered by column name."""
    keys = _table_key(by_name)
    entries = F.array_sort(F.collect_list(F.struct("column", "examples")))
    return examples.groupBy(*keys).agg(F.map_from_entries(entries).alias("column_examples"))


def column_types(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """INTEGER, REAL or TEXT per column, voted by all its values.

    A column of only missing values is TEXT.  What a value says is combined inside the
    tasks, so nothing is ranked or gathered.
    """
    keys = keys or [*TABLE_KEY, "column"]
    return cells.groupBy(*keys).agg(voted_sql_type(F.col("vtype"), F.col("value")).alias("sql_type"))


def average_table_size(tables: DataFrame) -> DataFrame:
    """Mean rows and columns over all tables; 0 without tables."""
    return tables.agg(
        F.coalesce(F.avg("n_rows"), F.lit(0.0)).alias("avg_rows"),
        F.coalesce(F.avg("n_cols"), F.lit(0.0)).alias("avg_cols"),
    )


def row_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def shares(df: DataFrame, *keys: str) -> DataFrame:
    """Count and share of every key combination, most frequent first.

    For keys of few values, such as tags and reasons: the counts meet in one task.
    """
    counted = df.groupBy(*keys).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counted.withColumn("share", F.col("count") / total).orderBy(F.desc("count"), *keys)


def shares_by_split(df: DataFrame, key: str) -> DataFrame:
    """Counts and shares per split and over all splits (``split`` NULL) in one pass."""
    fine = df.groupBy("split", key).agg(F.count("*").alias("count"))
    overall = fine.groupBy(key).agg(F.sum("count").alias("count")).withColumn("split", F.lit(None).cast("string"))
    both = fine.unionByName(overall)
    total = F.sum("count").over(Window.partitionBy("split"))
    return both.withColumn("share", F.col("count") / total)
