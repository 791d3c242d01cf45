"""Diagnostic subsets: query shape, table length, reasons for leaving a query out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableviews.functions.binding import with_computed
from tableviews.functions.hashing import stable_hash
from tableviews.functions.sqltext import is_pure_lookup, sql_tables, sql_tags, sql_type
from tableviews.operators.ordering import spread_join, top_per_group

# Reasons as they are reported.
MULTI_TABLE = "multi-table SQL"
NO_TABLE = "no-table SQL"
TOO_SHORT = "rows < min_rows"
TOO_LONG = "rows > max_rows"
NO_TAG = "no-tag"
OTHER_MODE = "filtered_by_sql_mode"
KEPT = "kept"
# Reported apart from the reasons: the table is not in the catalog and counts as empty.
UNKNOWN_TABLE = "unknown-table"

SHORT_MAX_ROWS = 100
LONG_MIN_ROWS = 101


def tag_queries(samples: DataFrame) -> DataFrame:
    """Add the tables, tags and type label of every SQL text."""
    tagged = with_computed(samples, "sql_tags", sql_tags(F.col("sql"))).withColumn("sql_tables", sql_tables(F.col("sql")))
    return tagged.withColumns(
        {"sql_type": sql_type(F.col("sql_tags")), "table_name": F.get("sql_tables", F.lit(0))}
    )


def with_row_counts(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """Row count of the first table of every query; names are compared without case.

    ``counts`` is (db, table_name, n_rows).  An unknown table counts as 0 rows and is flagged.
    """
    keyed = counts.select("db", F.lower("table_name").alias("__table"), F.col("n_rows").alias("__n"))
    keyed = keyed.groupBy("db", "__table").agg(F.max("__n").alias("__n"))
    left = queries.withColumn("__table", F.lower("table_name"))
    joined = spread_join(left, keyed, ["db", "__table"], ["sample_id"], "left")
    return joined.withColumns(
        {"n_rows": F.coalesce("__n", F.lit(0).cast("bigint")), "unknown_table": F.col("__n").isNull()}
    ).drop("__table", "__n")


def mode_matches(sql_mode: str) -> Column:
    """Whether the tags fit ``any``, ``lookup`` or ``compositional``."""
    pure = is_pure_lookup(F.col("sql_tags"))
    modes = {"any": F.lit(True), "lookup": pure, "compositional": ~pure}
    return modes[sql_mode]


def keep_reason(
    min_rows: int = 0, max_rows: int | None = None, sql_mode: str = "any", single_table_only: bool = True
) -> Column:
    """First rule a query fails, or ``kept``."""
    n_tables = F.size("sql_tables")
    rule = F.when(n_tables != 1, MULTI_TABLE) if single_table_only else F.when(F.lit(False), MULTI_TABLE)
    rule = rule.when(n_tables == 0, NO_TABLE).when(F.col("n_rows") < min_rows, TOO_SHORT)
    if max_rows is not None:
        rule = rule.when(F.col("n_rows") > max_rows, TOO_LONG)
    return rule.when(F.size("sql_tags") == 0, NO_TAG).when(~mode_matches(sql_mode), OTHER_MODE).otherwise(KEPT)


def subset_label(short_max: int = SHORT_MAX_ROWS, long_min: int = LONG_MIN_ROWS) -> Column:
    """Length class and shape class of a query in one label; NULL when it belongs to no subset."""
    length_class = F.when(F.col("n_rows") <= short_max, "short").when(F.col("n_rows") >= long_min, "long")
    shape_class = F.when(F.size("sql_tags") == 0, None).otherwise(
        F.when(is_pure_lookup(F.col("sql_tags")), "lookup").otherwise("compositional")
    )
    return F.when(F.size("sql_tables") == 1, F.concat(length_class, F.lit("_"), shape_class))


def rows_between(n_rows: Column, low: int | None = None, high: int | None = None) -> Column:
    """Inclusive range test with optional bounds."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (n_rows >= low)
    if high is not None:
        inside = inside & (n_rows <= high)
    return inside


def samples_with_tables_in_range(
    tables: DataFrame,
    low: int | None = None,
    high: int | None = None,
    min_tables: int = 2,
    sampled_tables: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Samples of which at least ``min_tables`` tables have a row count in the range.

    ``sampled_tables`` looks at that many tables per sample only, chosen by hash.
    """
    if sampled_tables is not None:
        hashed = tables.withColumn("__h", stable_hash(seed, "sample_id", "table_pos"))
        tables = top_per_group(hashed, ["sample_id"], ["__h", "table_pos"], sampled_tables).drop("__h")
    counted = tables.groupBy("sample_id").agg(
        F.min("ord").alias("ord"),
        F.count("*").alias("n_tables"),
        F.count_if(rows_between(F.col("n_rows"), low, high)).alias("n_in_range"),
    )
    return counted.filter(F.col("n_in_range") >= min_tables)


def first_n(df: DataFrame, group: str, n: int) -> DataFrame:
    """First n samples of every group in input order."""
    return top_per_group(df, [group], ["ord", "sample_id"], n)


def sample_per_type(df: DataFrame, n: int, seed: int = 42, group: str = "sql_type") -> DataFrame:
    """At most n samples per type, chosen by hash."""
    hashed = df.withColumn("__h", stable_hash(seed, "sample_id"))
    return top_per_group(hashed, [group], ["__h", "sample_id"], n).drop("__h")


def cap_rows(rows: DataFrame, keys: list[str], row_id: list[str], cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows per table, chosen by hash; shorter tables stay whole."""
    hashed = rows.withColumn("__h", stable_hash(seed, *row_id))
    return top_per_group(hashed, keys, ["__h", *row_id], cap).drop("__h")


def first_samples(samples: DataFrame, n: int) -> DataFrame:
    """The first n input records."""
    return samples.filter(F.col("ord") < n)


def one_sample(samples: DataFrame, index: int) -> DataFrame:
    return samples.filter(F.col("ord") == index)


def columns_of_table(meta: DataFrame) -> DataFrame:
    """Ordered columns per (db, table) from database metadata.

    ``meta`` is (db, table_names, column_names ARRAY<STRUCT<t_idx, column>>), one row per
    database, so the columns of a table are picked inside the row.
    """
    named = meta.select("db", "column_names", F.posexplode("table_names").alias("t_idx", "table_name"))
    own = F.filter("column_names", lambda c: c["t_idx"] == F.col("t_idx"))
    return named.select("db", "table_name", F.transform(own, lambda c: c["column"]).alias("columns"))


def with_database_keys(queries: DataFrame, meta: DataFrame) -> DataFrame:
    """Primary and foreign keys of each query's database; empty when it is unknown."""
    keyed = meta.select("db", "primary_keys", "foreign_keys")
    return spread_join(queries, keyed, ["db"], ["sample_id"], "left").withColumns(
        {k: F.coalesce(F.col(k), F.lit("[]")) for k in ("primary_keys", "foreign_keys")}
    )


def latest_meta(meta: DataFrame, key: str = "table_id") -> DataFrame:
    """One metadata row per key, the last one given (``ord``); of equal ``ord`` the one with the largest hash.

    Parts of one row (``part``, with ``markdown`` in pieces) are put together in order first.
    """
    if "part" in meta.columns:
        same = [c for c in meta.columns if c not in (key, "ord", "part", "markdown")]
        pieces = F.array_sort(F.collect_list(F.struct("part", "markdown")))
        whole = F.array_join(F.transform(pieces, lambda p: p["markdown"]), "\n").alias("markdown")
        firsts = [F.min_by(c, "part").alias(c) for c in same]
        meta = meta.groupBy(key, "ord").agg(whole, *firsts)
    fields = [c for c in meta.columns if c not in (key, "ord")]
    last = F.struct("ord", F.xxhash64(*fields))
    return meta.groupBy(key).agg(F.max_by(F.struct(*fields), last).alias("m")).select(key, "m.*")


def equal_counts(records: DataFrame) -> DataFrame:
    """Records that have as many tables as table names."""
    return records.filter(F.size("table_names") == F.size("tables"))
