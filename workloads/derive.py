"""Table corpora derived from the star-schema tables.

Two corpora are used.  In the order corpus every order is a sample whose table is its
line items; in the customer corpus every customer is a sample whose table is its orders.
Texts that both engines evaluate are kept once as SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableviews.operators.ordering import number_rows
from tableviews.session import spread

LINE_COLUMNS = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
# Row order of a line-item table; the three keys alone repeat in the smallest tables.
LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", *[c for c in LINE_COLUMNS if not c.endswith(("key", "number"))]]
LINE_TYPES = ["BIGINT"] * 3 + ["DOUBLE"] * 4 + ["STRING"] * 3
ORDER_COLUMNS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_TYPES = ["BIGINT", "STRING", "DOUBLE", "STRING", "STRING"]

# One SQL text per order in six shapes; chr(39) is the quote.
ORDER_SQL = """CASE o_orderkey % 6
 WHEN 0 THEN concat('SELECT l_extendedprice FROM lineitem WHERE l_linestatus = ', chr(39), o_orderstatus, chr(39))
 WHEN 1 THEN concat('SELECT l_returnflag FROM lineitem WHERE l_linenumber = ', CAST(o_orderkey % 7 + 1 AS STRING))
 WHEN 2 THEN concat('SELECT l_quantity, l_tax FROM lineitem WHERE l_linestatus LIKE ', chr(39), o_orderstatus, '%', chr(39))
 WHEN 3 THEN concat('SELECT SUM(l_quantity) FROM lineitem WHERE l_linestatus = ', chr(39), o_orderstatus, chr(39))
 WHEN 4 THEN 'SELECT l_shipdate FROM lineitem ORDER BY l_extendedprice DESC LIMIT 1'
 ELSE concat('SELECT o_orderstatus FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_discount > 0.0', CAST(o_orderkey % 9 AS STRING))
END"""

# One SQL text per customer over its orders.
CUSTOMER_SQL = """CASE c_custkey % 8
 WHEN 0 THEN concat('SELECT o_totalprice FROM orders WHERE o_orderstatus = ', chr(39), 'F', chr(39))
 WHEN 1 THEN concat('SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority LIKE ', chr(39), CAST(c_custkey % 5 + 1 AS STRING), '%', chr(39), ';')
 WHEN 2 THEN concat('SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND ', CAST(100000 + c_custkey % 100 * 1000 AS STRING))
 WHEN 3 THEN concat('SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderpriority IN (', chr(39), '1-URGENT', chr(39), ', ', chr(39), '5-LOW', chr(39), ')')
 WHEN 4 THEN 'SELECT o_orderpriority, COUNT(*) FROM orders GROUP BY o_orderpriority'
 WHEN 5 THEN 'SELECT o_orderstatus FROM orders GROUP BY o_orderstatus ORDER BY COUNT(*) DESC LIMIT 1'
 WHEN 6 THEN concat('SELECT MAX(o_totalprice) FROM orders WHERE o_orderstatus = ', chr(39), 'O', chr(39))
 ELSE 'SELECT o_orderkey FROM orders LIMIT 2'
END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for heavy work per row, dealt out anew: the given tables are single files of one row group."""
    return spread(table(spark, sf_dir, name), spark.sparkContext.defaultParallelism)


def names(columns: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in columns])


def sql_list(columns: list[str]) -> str:
    """List literal for DuckDB."""
    return "[" + ", ".join(f"'{c}'" for c in columns) + "]"


def duck(expr: str) -> str:
    """Shared expression in DuckDB's spelling."""
    return expr.replace("AS STRING", "AS VARCHAR")


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, ord, db, sql): one sample per order."""
    return spread_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_id"),
        F.col("o_orderkey").alias("ord"),
        F.col("o_orderpriority").alias("db"),
        F.expr(ORDER_SQL).alias("sql"),
    )


ORDER_SAMPLES = f"""order_samples AS (
 SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderkey AS ord, o_orderpriority AS db, {duck(ORDER_SQL)} AS sql FROM orders)"""


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the order corpus: line items, and the orders themselves where the text joins them."""
    s = order_samples(spark, sf_dir)
    line = F.struct(F.lit("lineitem").alias("table_name"), names(LINE_COLUMNS).alias("columns"))
    order = F.struct(F.lit("orders").alias("table_name"), names(ORDER_COLUMNS).alias("columns"))
    both = F.when(F.col("ord") % 6 == 5, F.array(order, line)).otherwise(F.array(line))
    return s.select("*", F.posexplode(both).alias("table_pos", "t")).select(
        "sample_id", "ord", "db", "sql", "table_pos", "t.table_name", "t.columns"
    )


ORDER_HEADERS = f"""order_headers AS (
 SELECT sample_id, ord, db, sql, CASE WHEN ord % 6 = 5 THEN 1 ELSE 0 END AS table_pos, 'lineitem' AS table_name, {sql_list(LINE_COLUMNS)} AS columns FROM order_samples
 UNION ALL
 SELECT sample_id, ord, db, sql, 0, 'orders', {sql_list(ORDER_COLUMNS)} FROM order_samples WHERE ord % 6 = 5)"""


def _texts(columns: list[str]) -> list[Column]:
    dates = {"l_shipdate", "o_orderdate"}
    return [F.col(c).cast("date").cast("string") if c in dates else F.col(c).cast("string") for c in columns]


def _duck_text(column: str) -> str:
    return f"CAST(CAST({column} AS DATE) AS VARCHAR)" if column in ("l_shipdate", "o_orderdate") else f"CAST({column} AS VARCHAR)"


def order_rows(spark: SparkSession, sf_dir: str, nulls: bool = False) -> DataFrame:
    """Line items as rows of their order's table; with ``nulls`` some returned flags are missing."""
    lines = table(spark, sf_dir, "lineitem")
    numbered = number_rows(
        lines,
        ["l_orderkey"],
        LINE_ORDER,
        [F.floor(F.col("l_partkey") / 1048576).cast("bigint")],
    )
    cells = _texts(LINE_COLUMNS)
    kinds = [F.lit(t) for t in LINE_TYPES]
    if nulls:
        at = LINE_COLUMNS.index("l_returnflag")
        gone = F.col("l_partkey") % 4 == 0
        cells[at] = F.when(~gone, cells[at])
        kinds[at] = F.when(gone, "VOID").otherwise("STRING")
    return numbered.select(
        F.col("l_orderkey").cast("string").alias("sample_id"),
        F.lit(0).alias("table_pos"),
        "row_pos",
        "n_rows",
        F.array(*cells).alias("cells"),
        F.array(*kinds).alias("vtypes"),
    )


LINE_ROWS = f"""line_rows AS (
 SELECT CAST(l_orderkey AS VARCHAR) AS sample_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) - 1 AS row_pos, *
 FROM lineitem)"""


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-item table of every order, empty ones included."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sample_id")).agg(
        F.count("*").alias("n_rows")
    )
    return order_samples(spark, sf_dir).join(counts, "sample_id", "left").select(
        "sample_id", "ord", "db", F.lower("sql").alias("sql"), F.lit(0).alias("table_pos"),
        F.lit("lineitem").alias("table_name"), names(LINE_COLUMNS).alias("columns"),
        F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), F.lit(len(LINE_COLUMNS)).alias("n_cols"),
    )


def customer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, ord, db, sql, question): one sample per customer."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"),
        F.col("c_custkey").alias("ord"),
        F.col("c_mktsegment").alias("db"),
        F.expr(CUSTOMER_SQL).alias("sql"),
        F.concat(F.lit("What did "), F.col("c_name"), F.lit(" order?")).alias("question"),
    )


CUSTOMER_SAMPLES = f"""customer_samples AS (
 SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_custkey AS ord, c_mktsegment AS db, {duck(CUSTOMER_SQL)} AS sql,
  'What did ' || c_name || ' order?' AS question FROM customer)"""


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of their customer's table."""
    numbered = number_rows(
        table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], [F.floor(F.col("o_orderkey") / 1048576).cast("bigint")]
    )
    return numbered.select(
        F.col("o_custkey").cast("string").alias("sample_id"),
        F.lit(0).alias("table_pos"),
        "row_pos",
        "n_rows",
        F.array(*_texts(ORDER_COLUMNS)).alias("cells"),
        F.array(*[F.lit(t) for t in ORDER_TYPES]).alias("vtypes"),
    )


ORDER_ROWS = f"""order_rows AS (
 SELECT CAST(o_custkey AS VARCHAR) AS sample_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_pos,
  [{", ".join(_duck_text(c) for c in ORDER_COLUMNS)}] AS cells, * FROM orders)"""


def customer_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order table of every customer, empty ones included."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("sample_id")).agg(
        F.count("*").alias("n_rows")
    )
    return customer_samples(spark, sf_dir).join(counts, "sample_id", "left").select(
        "sample_id", "ord", "db", F.lower("sql").alias("sql"), F.lit(0).alias("table_pos"),
        F.lit("orders").alias("table_name"), names(ORDER_COLUMNS).alias("columns"),
        F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"), F.lit(len(ORDER_COLUMNS)).alias("n_cols"),
    )


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def duck_hash(seed: int, *columns: str) -> str:
    """The stable hash in DuckDB."""
    texts = ", ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"CAST(concat('0x', substr(md5(concat_ws('|', '{seed}', {texts})), 1, 8)) AS BIGINT)"


def joined(column: Column | str, separator: str = ", ") -> Column:
    return F.array_join(column, separator)
