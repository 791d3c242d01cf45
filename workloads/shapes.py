"""What SQL texts look like, and which queries go into which subset."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableviews.functions import sqltext
from tableviews.operators import profile, reshape, selection
from tableviews.plans import subsets as plans
from tableviews.sources import tabular
from workloads.derive import (
    CUSTOMER_SAMPLES, LINE_COLUMNS, LINE_ROWS, ORDER_COLUMNS, ORDER_SAMPLES, customer_samples, duck_hash, joined, names,
    order_rows, order_samples, order_tables, table, with_ctes,
)
from workloads.registry import query

# Texts and their tags are also written out in DuckDB, on the patterns of the tag rules.
_TAGGED = r"""tagged AS (
 SELECT *, regexp_replace(sql, '''[^'']*''', '''''', 'g') AS b,
  regexp_replace(regexp_replace(sql, '''[^'']*''', '''''', 'g'), '(?i)\b(?:on|using)\b.*?(\bwhere\b|\bgroup\s+by\b|\bhaving\b|\border\s+by\b|\blimit\b|$)', '\1', 'g') AS o
 FROM samples), marks AS (
 SELECT *, regexp_matches(b, '(?i)\b(sum|avg|count)\b') AS agg, regexp_matches(b, '(?i)\b(max|min)\b|\blimit\b.*\b1\b') AS ext,
  regexp_matches(b, '(?i)\bjoin\b') AS joins, regexp_matches(b, '(?i)\border\s+by\b') AS ranks,
  regexp_matches(o, '(?i)(<=|>=|<>|!=|=|<|>|\bbetween\b|\bin\b)\s*[+-]?\d') AS comp,
  NOT regexp_matches(sql, '(?i)\b(join|union|group|order|having|sum|avg|count|max|min|or)\b') AND NOT ends_with(sql, ';') AS plain FROM tagged), tags AS (
 SELECT * EXCLUDE (b, o), CASE WHEN agg OR ext OR joins OR ranks OR comp THEN array_to_string(list_filter(
   [CASE WHEN agg THEN 'Aggregation' END, CASE WHEN ext THEN 'Max/Min' END, CASE WHEN joins THEN 'Join' END,
    CASE WHEN ranks THEN 'Ranking' END, CASE WHEN comp THEN 'Comparison' END], lambda x: x IS NOT NULL), ',')
   WHEN plain THEN 'SimpleProjection' ELSE '' END AS sql_type FROM marks)"""
_SAMPLES = "samples AS (SELECT * FROM order_samples UNION ALL SELECT sample_id || 'c', ord, db, sql FROM customer_samples)"


def _samples(spark, sf_dir):
    customers = customer_samples(spark, sf_dir).select(F.concat("sample_id", F.lit("c")).alias("sample_id"), "ord", "db", "sql")
    return order_samples(spark, sf_dir).unionByName(customers)


@query(
    "sql_tables",
    with_ctes(ORDER_SAMPLES, CUSTOMER_SAMPLES, _SAMPLES)
    + r"""SELECT sample_id, array_to_string(CASE WHEN contains(sql, ' JOIN ') THEN ['orders', 'lineitem']
 ELSE regexp_extract_all(sql, '(?i)\b(?:from|join)\s+(\w+)', 1) END, ', ') AS sql_tables FROM samples""",
)
def sql_tables(spark, sf_dir):
    return _samples(spark, sf_dir).select("sample_id", joined(sqltext.sql_tables(F.col("sql"))).alias("sql_tables"))


@query("sql_tags", with_ctes(ORDER_SAMPLES, CUSTOMER_SAMPLES, _SAMPLES, _TAGGED) + "SELECT sample_id, sql_type FROM tags")
def sql_tags(spark, sf_dir):
    return selection.tag_queries(_samples(spark, sf_dir)).select("sample_id", "sql_type")


@query(
    "simple_lookups",
    with_ctes(CUSTOMER_SAMPLES) + """SELECT sample_id,
 ord % 8 IN (0, 2, 3, 7) AS is_lookup FROM customer_samples""",
)
def simple_lookups(spark, sf_dir):
    """Lookups by shape alone; a closing semicolon after WHERE makes a text no lookup."""
    return customer_samples(spark, sf_dir).select("sample_id", sqltext.is_lookup(F.col("sql")).alias("is_lookup"))


@query(
    "sql_type_share",
    with_ctes(ORDER_SAMPLES, CUSTOMER_SAMPLES, _SAMPLES, _TAGGED)
    + "SELECT sql_type, count(*) AS count, count(*) / sum(count(*)) OVER () AS share FROM tags GROUP BY sql_type",
)
def sql_type_share(spark, sf_dir):
    return profile.shares(selection.tag_queries(_samples(spark, sf_dir)), "sql_type")


@query(
    "sql_type_share_by_split",
    with_ctes(ORDER_SAMPLES, CUSTOMER_SAMPLES, _SAMPLES, _TAGGED, "counted AS (SELECT db AS split, sql_type, count(*) AS n, grouping(db) AS g FROM tags GROUP BY GROUPING SETS ((db, sql_type), (sql_type)))")
    + "SELECT split, sql_type, n AS count, n / sum(n) OVER (PARTITION BY split, g) AS share FROM counted",
)
def sql_type_share_by_split(spark, sf_dir):
    return profile.shares_by_split(selection.tag_queries(_samples(spark, sf_dir)).withColumnRenamed("db", "split"), "sql_type")


# A customer's orders stand for a catalog table; customers without orders are unknown tables.
_COUNTED = """counted AS (
 SELECT t.*, coalesce(c.n, 0) AS n_rows, c.n IS NULL AS unknown_table FROM tags t
 LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) c ON c.o_custkey = t.ord)"""
_CUSTOMER_ONLY = "samples AS (SELECT * FROM customer_samples)"


def _counted(spark, sf_dir):
    queries = selection.tag_queries(customer_samples(spark, sf_dir)).withColumn("db", F.col("sample_id"))
    counts = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("db"), F.lit("ORDERS").alias("table_name"))
    return selection.with_row_counts(queries, profile.row_counts(counts, ["db", "table_name"]))


@query(
    "subset_reasons",
    with_ctes(CUSTOMER_SAMPLES, _CUSTOMER_ONLY, _TAGGED, _COUNTED)
    + """SELECT reason, count(*) AS count, count(*) FILTER (unknown_table) AS n_unknown FROM (
 SELECT unknown_table, CASE WHEN n_rows < 5 THEN 'rows < min_rows' WHEN n_rows > 14 THEN 'rows > max_rows' WHEN sql_type = '' THEN 'no-tag'
  WHEN sql_type <> 'SimpleProjection' THEN 'filtered_by_sql_mode' ELSE 'kept' END AS reason FROM counted) GROUP BY reason""",
)
def subset_reasons(spark, sf_dir):
    reason = selection.keep_reason(min_rows=5, max_rows=14, sql_mode="lookup")
    return _counted(spark, sf_dir).withColumn("reason", reason).groupBy("reason").agg(
        F.count("*").alias("count"), F.count_if("unknown_table").alias("n_unknown")
    )


@query(
    "subset_reasons_multi_table",
    with_ctes(ORDER_SAMPLES, "samples AS (SELECT * FROM order_samples)", _TAGGED)
    + """SELECT db, CASE WHEN contains(sql, ' JOIN ') THEN 'multi-table SQL' WHEN sql_type = '' THEN 'no-tag'
 WHEN sql_type = 'SimpleProjection' THEN 'filtered_by_sql_mode' ELSE 'kept' END AS reason, count(*) AS count FROM tags GROUP BY ALL""",
)
def subset_reasons_multi_table(spark, sf_dir):
    reason = selection.keep_reason(sql_mode="compositional")
    tagged = selection.tag_queries(order_samples(spark, sf_dir)).withColumn("n_rows", F.lit(1))
    return tagged.groupBy("db", reason.alias("reason")).agg(F.count("*").alias("count"))


@query(
    "subsets",
    with_ctes(CUSTOMER_SAMPLES, _CUSTOMER_ONLY, _TAGGED, _COUNTED)
    + """SELECT sample_id, CAST(n_rows AS BIGINT) AS n_rows, sql_type, CASE WHEN n_rows <= 10 THEN 'short_' ELSE 'long_' END ||
 CASE WHEN sql_type = 'SimpleProjection' THEN 'lookup' ELSE 'compositional' END AS subset FROM counted WHERE sql_type <> ''""",
)
def subsets(spark, sf_dir):
    """All length and shape subsets in one pass."""
    labelled = _counted(spark, sf_dir).withColumn("subset", selection.subset_label(short_max=10, long_min=11))
    return labelled.filter(F.col("subset").isNotNull()).select("sample_id", "n_rows", "sql_type", "subset")


# A nation is a sample whose tables are its customers' order tables.
_NATION_TABLES = """nation_tables AS (
 SELECT CAST(c_nationkey AS VARCHAR) AS sample_id, c_nationkey AS ord, c_custkey AS table_pos, count(o_orderkey) AS n_rows
 FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"""


def _nation_tables(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined_counts = table(spark, sf_dir, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined_counts.select(
        F.col("c_nationkey").cast("string").alias("sample_id"), F.col("c_nationkey").alias("ord"),
        F.col("c_custkey").alias("table_pos"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"),
    )


@query(
    "range_split",
    with_ctes(_NATION_TABLES)
    + "SELECT sample_id, count(*) AS n_tables, count(*) FILTER (n_rows BETWEEN 8 AND 12) AS n_in_range FROM nation_tables GROUP BY sample_id HAVING n_in_range >= 2",
)
def range_split(spark, sf_dir):
    kept = selection.samples_with_tables_in_range(_nation_tables(spark, sf_dir), 8, 12, min_tables=2)
    return kept.select("sample_id", "n_tables", "n_in_range")


@query(
    "range_split_sampled_tables",
    with_ctes(_NATION_TABLES, f"picked AS (SELECT *, {duck_hash(42, 'sample_id', 'table_pos')} AS h FROM nation_tables QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY h, table_pos) <= 3)")
    + "SELECT sample_id, count(*) AS n_tables, count(*) FILTER (n_rows >= 11) AS n_in_range FROM picked GROUP BY sample_id HAVING n_in_range >= 1",
)
def range_split_sampled_tables(spark, sf_dir):
    kept = selection.samples_with_tables_in_range(_nation_tables(spark, sf_dir), 11, None, min_tables=1, sampled_tables=3)
    return kept.select("sample_id", "n_tables", "n_in_range")


@query(
    "first_n_per_group",
    with_ctes(CUSTOMER_SAMPLES)
    + "SELECT db, sample_id FROM customer_samples QUALIFY row_number() OVER (PARTITION BY db ORDER BY ord) <= 20",
)
def first_n_per_group(spark, sf_dir):
    return selection.first_n(customer_samples(spark, sf_dir), "db", 20).select("db", "sample_id")


@query(
    "multi_table_union",
    with_ctes(_NATION_TABLES)
    + """SELECT 'short' AS subset, sample_id FROM nation_tables GROUP BY sample_id HAVING count(*) FILTER (n_rows BETWEEN 1 AND 10) >= 2
UNION ALL SELECT 'long', sample_id FROM nation_tables GROUP BY sample_id HAVING count(*) FILTER (n_rows >= 11) >= 2""",
)
def multi_table_union(spark, sf_dir):
    tables = _nation_tables(spark, sf_dir)
    short = selection.samples_with_tables_in_range(tables, 1, 10).select(F.lit("short").alias("subset"), "sample_id")
    long = selection.samples_with_tables_in_range(tables, 11).select(F.lit("long").alias("subset"), "sample_id")
    return short.unionByName(long)


@query(
    "multi_table_subsets",
    with_ctes(
        _NATION_TABLES, "grouped AS (SELECT t.*, r_name AS grp FROM nation_tables t JOIN nation ON n_nationkey = t.ord JOIN region ON r_regionkey = n_regionkey)",
        """fit AS (SELECT s.subset, grp, sample_id, any_value(ord) AS ord FROM grouped,
 (VALUES ('short', 1, 10), ('long', 11, 1000000), ('any', -1, 1000000)) AS s(subset, low, high) WHERE n_rows BETWEEN low AND high GROUP BY ALL HAVING count(*) >= 2)""",
    )
    + "SELECT subset, grp, sample_id, ord FROM fit QUALIFY row_number() OVER (PARTITION BY subset, grp ORDER BY ord, sample_id) <= 3",
)
def multi_table_subsets(spark, sf_dir):
    """The first three nations of each region with enough short, long, or any tables."""
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    grouped = _nation_tables(spark, sf_dir).join(regions.select(F.col("n_nationkey").alias("ord"), F.col("r_name").alias("grp")), "ord")
    return plans.multi_table_subsets(grouped, "grp", short=(1, 10), long_min=11, per_group=3, with_any_length=True)


@query(
    "sample_per_type",
    with_ctes(ORDER_SAMPLES, CUSTOMER_SAMPLES, _SAMPLES, _TAGGED)
    + f"SELECT sql_type, sample_id FROM tags QUALIFY row_number() OVER (PARTITION BY sql_type ORDER BY {duck_hash(42, 'sample_id')}, sample_id) <= 100",
)
def sample_per_type(spark, sf_dir):
    return selection.sample_per_type(selection.tag_queries(_samples(spark, sf_dir)), 100).select("sql_type", "sample_id")


@query(
    "row_cap",
    f"""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY {duck_hash(42, 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')}, l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 1000""",
)
def row_cap(spark, sf_dir):
    row_id = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", *row_id)
    return selection.cap_rows(rows, ["l_returnflag"], row_id, 1000)


@query("first_samples", with_ctes(CUSTOMER_SAMPLES) + "SELECT sample_id, ord FROM customer_samples WHERE ord < 50")
def first_samples(spark, sf_dir):
    """The first records by place in the input, as a limit on the number of samples does."""
    return selection.first_samples(customer_samples(spark, sf_dir), 50).select("sample_id", "ord")


@query("one_sample", with_ctes(CUSTOMER_SAMPLES) + "SELECT sample_id, ord, sql FROM customer_samples WHERE ord = 17")
def one_sample(spark, sf_dir):
    return selection.one_sample(customer_samples(spark, sf_dir), 17).select("sample_id", "ord", "sql")


@query(
    "table_columns",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS db, table_name, columns FROM orders CROSS JOIN
 (VALUES ('orders', '{", ".join(ORDER_COLUMNS)}'), ('lineitem', '{", ".join(LINE_COLUMNS)}'), ('empty', '')) AS t(table_name, columns)""",
)
def table_columns(spark, sf_dir):
    """Ordered columns per table from nested metadata; every order brings the metadata of one database."""
    entry = lambda i, c: F.struct(F.lit(i).alias("t_idx"), F.lit(c).alias("column"))
    both = [entry(0, c) for c in ORDER_COLUMNS] + [entry(1, c) for c in LINE_COLUMNS]
    meta = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("db"), names(["orders", "lineitem", "empty"]).alias("table_names"),
        F.array(*both).alias("column_names"),
    )
    return selection.columns_of_table(meta).select("db", "table_name", joined("columns").alias("columns"))


@query(
    "catalog_rows",
    """SELECT 'main' AS db, 'orders' AS table_name, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_pos, count(*) OVER () AS n_rows,
 CAST(o_orderkey AS VARCHAR) AS first_cell, 'BIGINT,BIGINT,STRING,DOUBLE,STRING,STRING' AS kinds FROM orders""",
)
def catalog_rows(spark, sf_dir):
    """A whole table of a catalog as numbered rows: one key, cut into splits of its order."""
    rows = tabular.table_as_rows(
        table(spark, sf_dir, "orders"), "main", "orders", ["o_orderkey"], [F.floor(F.col("o_orderkey") / 1048576).cast("bigint")]
    )
    return rows.select("db", "table_name", "row_pos", "n_rows", F.get("cells", F.lit(0)).alias("first_cell"), joined("vtypes", ",").alias("kinds"))


@query(
    "database_keys",
    with_ctes(ORDER_SAMPLES)
    + """SELECT sample_id, CASE WHEN db LIKE '1%' OR db LIKE '2%' THEN '[["' || db || '",1]]' ELSE '[]' END AS primary_keys, '[]' AS foreign_keys FROM order_samples""",
)
def database_keys(spark, sf_dir):
    known = order_samples(spark, sf_dir).filter("db LIKE '1%' OR db LIKE '2%'").select("db").distinct()
    meta = known.select("db", F.format_string('[["%s",1]]', "db").alias("primary_keys"), F.lit("[]").alias("foreign_keys"))
    keyed = selection.with_database_keys(order_samples(spark, sf_dir), meta)
    return keyed.select("sample_id", "primary_keys", "foreign_keys")


@query(
    "query_table_content",
    with_ctes(CUSTOMER_SAMPLES, "samples AS (SELECT * FROM customer_samples)", _TAGGED)
    + f"""SELECT t.sample_id, o.o_orderkey, o.o_totalprice FROM tags t JOIN orders o ON o.o_custkey = t.ord
WHERE t.sql_type = 'SimpleProjection'""",
)
def query_table_content(spark, sf_dir):
    """Kept queries with the whole content of their table."""
    kept = selection.tag_queries(customer_samples(spark, sf_dir)).filter(selection.mode_matches("lookup"))
    return kept.join(table(spark, sf_dir, "orders"), F.col("ord") == F.col("o_custkey")).select("sample_id", "o_orderkey", "o_totalprice")


@query(
    "table_versions",
    with_ctes(LINE_ROWS)
    + """SELECT 'raw' AS stage, count(*) AS n_rows FROM line_rows UNION ALL SELECT 'complete', count(*) FROM line_rows WHERE l_partkey % 4 <> 0""",
)
def table_versions(spark, sf_dir):
    """Both versions of the tables side by side, chosen by ``stage``."""
    rows = order_rows(spark, sf_dir, nulls=True)
    complete = rows.filter(reshape.complete_in(F.array(F.lit(7)), F.col("cells")))
    both = rows.withColumn("stage", F.lit("raw")).unionByName(complete.withColumn("stage", F.lit("complete")))
    return both.groupBy("stage").agg(F.count("*").alias("n_rows"))


@query(
    "well_formed_tables",
    with_ctes(ORDER_SAMPLES) + "SELECT db, count(*) AS n_tables FROM order_samples WHERE ord % 5 <> 0 GROUP BY db",
)
def well_formed_tables(spark, sf_dir):
    """Tables whose header repeats a name are left out."""
    tables = order_tables(spark, sf_dir)
    doubled = F.when(F.col("ord") % 5 == 0, F.concat("columns", F.array(F.lit("L_TAX")))).otherwise(F.col("columns"))
    return reshape.well_formed(tables.withColumn("columns", doubled)).groupBy("db").agg(F.count("*").alias("n_tables"))


@query(
    "equal_counts",
    with_ctes(ORDER_SAMPLES) + "SELECT sample_id FROM order_samples WHERE ord % 3 = ord % 4",
)
def equal_counts(spark, sf_dir):
    s = order_samples(spark, sf_dir)
    sized = s.withColumns(
        {
            "table_names": F.array_repeat(F.lit("t"), (F.col("ord") % 3).cast("int")),
            "tables": F.array_repeat(F.lit("x"), (F.col("ord") % 4).cast("int")),
        }
    )
    return selection.equal_counts(sized).select("sample_id")


@query(
    "meta_join",
    """WITH meta AS (SELECT doc_id, quality, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality * 2 + toxic DESC) = 1)
SELECT d.doc_id, d.lang, m.quality, m.toxic FROM documents d JOIN meta m USING (doc_id) WHERE d.lang = 'en' AND m.quality <> 0""",
)
def meta_join(spark, sf_dir):
    """Questions with their table's metadata: one sub-task kept, one structure type left out."""
    meta = selection.latest_meta(table(spark, sf_dir, "labels").withColumn("ord", F.col("quality") * 2 + F.col("toxic")), "doc_id")
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select("doc_id", "lang")
    return docs.join(meta, "doc_id").filter(~F.col("quality").isin(0)).select("doc_id", "lang", "quality", "toxic")


@query(
    "structure_share",
    """SELECT source AS struct_type, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' GROUP BY source""",
)
def structure_share(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select("doc_id", F.col("source").alias("struct_type"))
    return profile.shares(docs.join(table(spark, sf_dir, "labels"), "doc_id"), "struct_type")
