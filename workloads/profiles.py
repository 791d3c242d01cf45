"""Column use, examples, types, sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tableviews.operators import profile, reshape
from tableviews.plans import profile_state
from tableviews.session import checkpoint_folder
from workloads.derive import (
    CUSTOMER_SAMPLES, LINE_COLUMNS, LINE_ROWS, ORDER_COLUMNS, ORDER_HEADERS, ORDER_ROWS, ORDER_SAMPLES, customer_rows, customer_tables,
    joined, names, order_headers, order_rows, order_samples, order_tables, sql_list, table, with_ctes,
)
from workloads.registry import query

_MENTIONS = """mentions AS (
 SELECT sample_id, db, table_name, ord, c AS column_name, contains(lower(sql), lower(c)) AS hit
 FROM (SELECT sample_id, db, table_name, ord, sql, unnest(columns) AS c FROM order_headers))"""


@query(
    "column_usage",
    with_ctes(ORDER_SAMPLES, ORDER_HEADERS, _MENTIONS, """per_column AS (
 SELECT db, table_name, column_name, bool_or(hit) AS used FROM mentions GROUP BY ALL)""") + """
SELECT db, table_name,
 coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (used), '') AS matched_columns,
 coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (NOT used), '') AS unmatched_columns,
 count(*) FILTER (used) / count(*) AS match_rate
FROM per_column GROUP BY db, table_name""",
)
def column_usage(spark, sf_dir):
    used = profile.column_usage(order_headers(spark, sf_dir))
    return used.select(
        "db", "table_name", joined("matched_columns").alias("matched_columns"),
        joined("unmatched_columns").alias("unmatched_columns"), "match_rate",
    )


@query(
    "merged_profile",
    with_ctes(ORDER_SAMPLES, ORDER_HEADERS, _MENTIONS, """per_column AS (
 SELECT db, table_name, column_name, count(*) AS total, count(*) FILTER (hit) AS matched FROM mentions GROUP BY ALL), seen AS (
 SELECT db, table_name, count(*) AS n_samples FROM order_headers GROUP BY ALL)""") + """
SELECT db, table_name, n_samples,
 coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (matched > 0), '') AS matched_columns,
 coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (matched / total >= 0.5), '') AS high_freq_columns
FROM per_column JOIN seen USING (db, table_name) GROUP BY db, table_name, n_samples""",
)
def merged_profile(spark, sf_dir):
    """Usage and frequent columns of all orders from the stored states of three batches."""
    folder = f"{checkpoint_folder(spark)}/profile-{uuid.uuid4().hex}"
    headers = order_headers(spark, sf_dir).withColumns({"n_rows": F.lit(0).cast("bigint"), "n_cols": F.size("columns")})
    for batch in range(3):
        own = headers.filter(F.col("ord") % 3 == batch)
        profile_state.add_batch(profile_state.state_of(own, own.select(F.col("table_name").alias("kind"))), folder, str(batch))
    state = profile_state.merged(spark, folder)
    used = profile.usage_of(state.columns).select("db", "table_name", joined("matched_columns").alias("matched_columns"))
    high = profile.high_freq_of(state.columns).select("db", "table_name", joined("high_freq_columns").alias("high_freq_columns"))
    seen = state.tables.select("db", "table_name", F.col("count").alias("n_samples"))
    return used.join(high, ["db", "table_name"]).join(seen, ["db", "table_name"])


@query(
    "column_usage_by_name",
    with_ctes(ORDER_SAMPLES, ORDER_HEADERS, _MENTIONS, """per_column AS (
 SELECT table_name, column_name, bool_or(hit) AS used, arg_max(db, ord) AS db, max(ord) AS ord FROM mentions GROUP BY ALL)""") + """
SELECT table_name, arg_max(db, ord) AS db,
 coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (used), '') AS matched_columns,
 count(*) FILTER (used) / count(*) AS match_rate
FROM per_column GROUP BY table_name""",
)
def column_usage_by_name(spark, sf_dir):
    used = profile.column_usage(order_headers(spark, sf_dir), by_name=True)
    return used.select("table_name", "db", joined("matched_columns").alias("matched_columns"), "match_rate")


@query(
    "column_usage_words",
    with_ctes(ORDER_SAMPLES, ORDER_HEADERS, """per_column AS (
 SELECT db, table_name, c, bool_or(regexp_matches(sql, '(?i)(^|\\W)' || c || '(\\W|$)')) AS used
 FROM (SELECT db, table_name, sql, unnest(columns) AS c FROM order_headers) GROUP BY ALL)""") + """
SELECT db, table_name, coalesce(string_agg(c, ', ' ORDER BY c) FILTER (used), '') AS matched_columns
FROM per_column GROUP BY db, table_name""",
)
def column_usage_words(spark, sf_dir):
    used = profile.column_usage(order_headers(spark, sf_dir), word=True)
    return used.select("db", "table_name", joined("matched_columns").alias("matched_columns"))


@query(
    "high_freq_columns",
    with_ctes(ORDER_SAMPLES, ORDER_HEADERS, _MENTIONS, """per_column AS (
 SELECT db, table_name, column_name, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) >= 0.5 AS high FROM mentions GROUP BY ALL)""") + """
SELECT db, table_name,
 coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (high), '') AS high_freq_columns,
 coalesce(string_agg(column_name, ', ' ORDER BY column_name) FILTER (NOT high), '') AS low_freq_columns,
 count(*) FILTER (high) / count(*) AS match_rate
FROM per_column GROUP BY db, table_name""",
)
def high_freq_columns(spark, sf_dir):
    high = profile.high_freq_columns(order_headers(spark, sf_dir))
    return high.select(
        "db", "table_name", joined("high_freq_columns").alias("high_freq_columns"),
        joined("low_freq_columns").alias("low_freq_columns"), "match_rate",
    )


@query(
    "table_frequency",
    with_ctes(ORDER_SAMPLES, ORDER_HEADERS) + "SELECT table_name, count(*) AS count FROM order_headers GROUP BY table_name ORDER BY count DESC, table_name",
)
def table_frequency(spark, sf_dir):
    return profile.table_frequency(order_headers(spark, sf_dir).select("table_name"))


@query("distinct_tables", with_ctes(ORDER_SAMPLES, ORDER_HEADERS) + "SELECT count(DISTINCT table_name) AS n_tables FROM order_headers")
def distinct_tables(spark, sf_dir):
    return profile.distinct_tables(order_headers(spark, sf_dir).select("table_name"))


_ORDER_CELLS = f"""order_cells AS (
 SELECT sample_id, row_pos, unnest(range({len(ORDER_COLUMNS)})) AS col_pos, unnest({sql_list(ORDER_COLUMNS)}) AS column_name, unnest(cells) AS value FROM order_rows)"""
_LINE_TEXTS = ", ".join(f"CAST({c} AS VARCHAR)" for c in ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])


@query(
    "cells",
    with_ctes(ORDER_ROWS, _ORDER_CELLS) + """
SELECT sample_id, CAST(row_pos AS BIGINT) AS row_pos, CAST(col_pos AS INTEGER) AS col_pos, column_name, value FROM order_cells""",
)
def cells(spark, sf_dir):
    long = reshape.cells_of(customer_rows(spark, sf_dir), customer_tables(spark, sf_dir))
    return long.select("sample_id", "row_pos", "col_pos", F.col("column").alias("column_name"), "value")


@query(
    "records",
    with_ctes(ORDER_ROWS) + """
SELECT sample_id, CAST(row_pos AS BIGINT) AS row_pos, CAST(o_orderstatus AS VARCHAR) AS status, CAST(o_totalprice AS VARCHAR) AS price FROM order_rows""",
)
def records(spark, sf_dir):
    """Rows as named columns, through the long form and back."""
    tables = customer_tables(spark, sf_dir)
    back = reshape.from_cells(reshape.cells_of(customer_rows(spark, sf_dir), tables))
    named = reshape.as_records(back.withColumn("columns", names(ORDER_COLUMNS)))
    return named.select(
        "sample_id", "row_pos", F.element_at("record", "o_orderstatus").alias("status"), F.element_at("record", "o_totalprice").alias("price")
    )


@query(
    "column_examples",
    with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS, _ORDER_CELLS, """firsts AS (
 SELECT db, min(ord) AS ord FROM customer_samples GROUP BY db), firsts_id AS (
 SELECT f.db, s.sample_id FROM firsts f JOIN customer_samples s ON s.db = f.db AND s.ord = f.ord), vals AS (
 SELECT f.db, c.column_name, c.value, min(c.row_pos) AS row_pos FROM firsts_id f JOIN order_cells c ON c.sample_id = f.sample_id
 WHERE c.value IS NOT NULL AND c.value <> '' GROUP BY ALL), top AS (
 SELECT * FROM vals QUALIFY row_number() OVER (PARTITION BY db, column_name ORDER BY row_pos) <= 3)""", f"""cols AS (
 SELECT db, unnest({sql_list(ORDER_COLUMNS)}) AS column_name FROM firsts)""") + """
SELECT cols.db, 'orders' AS table_name, cols.column_name, coalesce(string_agg(value, ' | ' ORDER BY row_pos), '') AS examples
FROM cols LEFT JOIN top ON top.db = cols.db AND top.column_name = cols.column_name GROUP BY ALL""",
)
def column_examples(spark, sf_dir):
    found = profile.column_examples(customer_rows(spark, sf_dir), customer_tables(spark, sf_dir))
    return found.select("db", "table_name", F.col("column").alias("column_name"), joined("examples", " | ").alias("examples"))


@query(
    "column_examples_retry",
    with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS, _ORDER_CELLS, """filled AS (
 SELECT s.db, s.ord, c.column_name, c.value, c.row_pos FROM customer_samples s JOIN order_cells c ON c.sample_id = s.sample_id
 WHERE c.value IS NOT NULL AND c.value <> ''), firsts AS (
 SELECT db, column_name, min(ord) AS ord FROM filled GROUP BY ALL), vals AS (
 SELECT f.db, f.column_name, f.value, min(f.row_pos) AS row_pos FROM filled f
 JOIN firsts USING (db, column_name, ord) GROUP BY ALL), top AS (
 SELECT * FROM vals QUALIFY row_number() OVER (PARTITION BY db, column_name ORDER BY row_pos) <= 3)""") + """
SELECT db, 'orders' AS table_name, column_name, string_agg(value, ' | ' ORDER BY row_pos) AS examples FROM top GROUP BY ALL""",
)
def column_examples_retry(spark, sf_dir):
    found = profile.column_examples(customer_rows(spark, sf_dir), customer_tables(spark, sf_dir), retry=True)
    return found.select("db", "table_name", F.col("column").alias("column_name"), joined("examples", " | ").alias("examples"))


@query(
    "column_types",
    with_ctes(ORDER_ROWS, _ORDER_CELLS, """votes AS (
 SELECT sample_id, column_name, value, CASE column_name WHEN 'o_orderkey' THEN 'BIGINT' WHEN 'o_totalprice' THEN 'DOUBLE' ELSE 'STRING' END AS kind
 FROM order_cells WHERE value IS NOT NULL)""") + """
SELECT sample_id, column_name, CASE WHEN bool_or(kind = 'DOUBLE') THEN 'REAL' WHEN bool_or(kind = 'BIGINT') THEN 'INTEGER'
 WHEN bool_or(TRY_CAST(value AS BIGINT) IS NULL AND TRY_CAST(value AS DOUBLE) IS NOT NULL) THEN 'REAL'
 WHEN bool_or(TRY_CAST(value AS BIGINT) IS NOT NULL) THEN 'INTEGER' ELSE 'TEXT' END AS sql_type
FROM votes GROUP BY ALL""",
)
def column_types(spark, sf_dir):
    long = reshape.cells_of(customer_rows(spark, sf_dir), customer_tables(spark, sf_dir))
    return profile.column_types(long, ["sample_id", "column"]).select("sample_id", F.col("column").alias("column_name"), "sql_type")


_SIZED = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


@query(
    "table_sizes",
    " UNION ALL ".join(f"SELECT 'main' AS db, '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _SIZED),
)
def table_sizes(spark, sf_dir):
    listed = None
    for name in _SIZED:
        keyed = table(spark, sf_dir, name).select(F.lit("main").alias("db"), F.lit(name).alias("table_name"))
        listed = keyed if listed is None else listed.unionByName(keyed)
    return profile.row_counts(listed, ["db", "table_name"])


@query(
    "average_table_size",
    """WITH t AS (SELECT c_custkey, count(o_orderkey) AS n_rows FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT avg(n_rows) AS avg_rows, CAST(5 AS DOUBLE) AS avg_cols FROM t""",
)
def average_table_size(spark, sf_dir):
    return profile.average_table_size(customer_tables(spark, sf_dir))


@query(
    "drop_empty_columns",
    with_ctes(ORDER_SAMPLES, LINE_ROWS, """kept AS (
 SELECT sample_id, count(CASE WHEN l_partkey % 4 <> 0 THEN 1 END) > 0 AS has_flag FROM line_rows GROUP BY sample_id)""") + f"""
SELECT s.sample_id, CASE WHEN has_flag IS NULL THEN 0 WHEN has_flag THEN {len(LINE_COLUMNS)} ELSE {len(LINE_COLUMNS) - 1} END AS n_cols,
 CASE WHEN has_flag IS NULL THEN '' WHEN has_flag THEN '{", ".join(LINE_COLUMNS)}' ELSE '{", ".join(c for c in LINE_COLUMNS if c != "l_returnflag")}' END AS columns
FROM order_samples s LEFT JOIN kept k ON k.sample_id = s.sample_id""",
)
def drop_empty_columns(spark, sf_dir):
    tables = order_tables(spark, sf_dir)
    _, narrow = reshape.drop_empty_columns(order_rows(spark, sf_dir, nulls=True), tables)
    return narrow.select("sample_id", "n_cols", joined("columns").alias("columns"))


_ALIASES = "VALUES ('1-URGENT', 'l_tax', 'l_levy'), ('5-LOW', 'l_quantity', 'l_amount'), ('5-LOW', 'l_discount', 'l_rebate')"


@query(
    "column_aliases",
    with_ctes(ORDER_SAMPLES) + """
SELECT sample_id, CASE db
 WHEN '1-URGENT' THEN regexp_replace(sql, '\\bl_tax\\b', 'l_levy', 'g')
 WHEN '5-LOW' THEN regexp_replace(regexp_replace(sql, '\\bl_quantity\\b', 'l_amount', 'g'), '\\bl_discount\\b', 'l_rebate', 'g')
 ELSE sql END AS sql,
 CASE db WHEN '1-URGENT' THEN replace(cols, 'l_tax', 'l_levy')
 WHEN '5-LOW' THEN replace(replace(cols, 'l_quantity', 'l_amount'), 'l_discount', 'l_rebate') ELSE cols END AS columns
FROM order_samples CROSS JOIN (SELECT '""" + ", ".join(LINE_COLUMNS) + """' AS cols)""",
)
def column_aliases(spark, sf_dir):
    aliases = spark.sql(f"SELECT * FROM {_ALIASES} AS a(db, old, new)")
    patched = reshape.rename_in_sql(order_samples(spark, sf_dir), aliases)
    tables = order_tables(spark, sf_dir)
    renamed = reshape.rename_columns(tables, aliases).select("sample_id", joined("columns").alias("columns"))
    return patched.select("sample_id", "sql").join(renamed, "sample_id")
