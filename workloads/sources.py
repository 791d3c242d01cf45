"""Corpora, CSV tables, metadata and prompts written to the shared folder and read back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableviews.functions.text import fill_prompt, percent_text
from tableviews.operators import reshape, selection, verbalize
from tableviews.session import checkpoint_folder, stored
from tableviews.sources import corpus, tabular
from workloads.derive import CUSTOMER_SAMPLES, ORDER_COLUMNS, ORDER_ROWS, customer_rows, customer_samples, names, table, with_ctes
from workloads.registry import query

SPLITS = ("even", "odd")
# Blocks of one large file; small, so that the files written here have several.
LIST_BLOCK = 1 << 20


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/sources-{uuid.uuid4().hex}"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as one record of the corpus format, with its orders as raw and as present table."""
    order = F.struct("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").cast("string").alias("d"), "o_orderpriority")
    cell = lambda o: F.array(*[o[c].cast("string") for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "d", "o_orderpriority")])
    # a customer's orders are one table of a record
    held = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(order)), cell).alias("rows"))
    filled = customer_samples(spark, sf_dir).join(held, F.col("ord") == F.col("o_custkey"), "left")
    rows = F.coalesce("rows", F.array().cast("array<array<string>>"))
    tables = lambda r: F.array(F.struct(names(ORDER_COLUMNS).alias("table_columns"), r.alias("table_content")))
    listed = F.array(F.lit("orders"))
    return filled.select(
        (F.col("ord") % 2).alias("half"),
        F.struct(
            F.col("sample_id").alias("id_"), "db", F.col("question").alias("Question"), F.array(F.array("sample_id")).alias("answer"),
            F.col("sql").alias("SQL"), listed.alias("table_names"), tables(F.slice(rows, 1, 2)).alias("tables"),
            F.struct(listed.alias("table_names"), tables(rows).alias("tables")).alias("raw_tables"),
        ).alias("r"),
    )


def _read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    records = _records(spark, sf_dir)
    for half, name in enumerate(SPLITS):
        corpus.write_json_lines(records.filter(F.col("half") == half).select("r.*"), f"{folder}/{name}")
    return corpus.read_splits(spark, {name: f"{folder}/{name}" for name in SPLITS}, lines=True)


_SPLIT = "CASE WHEN ord % 2 = 0 THEN 'even_' ELSE 'odd_' END || sample_id"


@query(
    "corpus_samples",
    with_ctes(CUSTOMER_SAMPLES) + f"""SELECT {_SPLIT} AS sample_id, db, question, sql, '[["' || sample_id || '"]]' AS answer,
 CAST((SELECT count(*) FROM customer_samples) AS BIGINT) AS n_places FROM customer_samples""",
)
def corpus_samples(spark, sf_dir):
    """Two splits written as JSON lines and read as samples whose ids and places stay apart."""
    samples = reshape.samples_of(_read_back(spark, sf_dir))
    places = samples.select("ord").distinct().agg(F.count("*").alias("n_places"))
    keyed = samples.select("sample_id", "db", "question", "sql", F.to_json("answer").alias("answer"), F.lit(1).alias("one"))
    return keyed.join(places.withColumn("one", F.lit(1)), "one").drop("one")


@query(
    "corpus_rows",
    with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS) + f"""SELECT 'raw' AS version, {_SPLIT.replace('sample_id', 's.sample_id')} AS sample_id, o.row_pos, array_to_string(o.cells, '|') AS cells
 FROM customer_samples s JOIN order_rows o ON o.sample_id = s.sample_id
 UNION ALL SELECT 'present', {_SPLIT.replace('sample_id', 's.sample_id')}, o.row_pos, array_to_string(o.cells, '|')
 FROM customer_samples s JOIN order_rows o ON o.sample_id = s.sample_id WHERE o.row_pos < 2""",
)
def corpus_rows(spark, sf_dir):
    """Both versions of the tables of a corpus, from its files to rows."""
    records = _read_back(spark, sf_dir)

    def of(version: str, field: str) -> DataFrame:
        rows = reshape.rows_of(reshape.tables_of(records, field))
        return rows.select(F.lit(version).alias("version"), "sample_id", "row_pos", F.array_join("cells", "|").alias("cells"))

    return of("raw", "raw_tables").unionByName(of("present", "tables"))


@query(
    "corpus_array",
    "SELECT CAST(n_nationkey AS VARCHAR) AS sample_id, n_name AS question, r_name AS db FROM nation JOIN region ON r_regionkey = n_regionkey",
)
def corpus_array(spark, sf_dir):
    """One file that holds a list of records."""
    folder = _folder(spark)
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    record = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("Question"), F.col("r_name").alias("db")))
    # the nations are one short list
    text = named.agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]")).alias("value"))
    text.coalesce(1).write.text(folder)
    return reshape.samples_of(corpus.read_json_array(spark, folder)).select("sample_id", "question", "db")


@query(
    "corpus_list",
    with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS) + """SELECT s.sample_id, s.question, s.ord - min(s.ord) OVER () AS place, o.row_pos, array_to_string(o.cells, '|') AS cells
 FROM customer_samples s LEFT JOIN order_rows o ON o.sample_id = s.sample_id""",
)
def corpus_list(spark, sf_dir):
    """All customers and their orders in one file of one list, read by its blocks: records, their places and their rows."""
    folder = _folder(spark)
    records = _records(spark, sf_dir).select(F.col("r.id_").cast("bigint").alias("place"), "r.id_", "r.db", "r.Question", "r.SQL", "r.raw_tables")
    corpus.write_json_array(records, folder, "place")
    read = stored(corpus.read_json_array(spark, folder, block_bytes=LIST_BLOCK))
    samples, rows = reshape.samples_of(read), reshape.rows_of(reshape.tables_of(read, "raw_tables"))
    cells = rows.select("sample_id", "row_pos", F.array_join("cells", "|").alias("cells"))
    return samples.select("sample_id", "question", F.col("ord").alias("place")).join(cells, "sample_id", "left")


@query(
    "rejected_lines",
    """SELECT event_id % 5 = 0 AS is_rejected, count(*) AS n, count(*) FILTER (event_id % 5 = 1) AS n_nan FROM events GROUP BY ALL""",
)
def rejected_lines(spark, sf_dir):
    """Lines that are no JSON come back as rows, and the number NaN is read."""
    folder = _folder(spark)
    key = F.col("event_id").cast("string")
    value = F.when(F.col("event_id") % 5 == 1, F.lit("NaN")).otherwise(F.lit("1.5"))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"id": '), key, F.lit(",}"))).otherwise(F.concat(F.lit('{"id": '), key, F.lit(', "v": '), value, F.lit("}")))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    read = corpus.read_json_lines(spark, folder, rejected="rows")
    lost = F.col("rejected").isNotNull()
    number = F.try_variant_get("record", "$.v", "string")
    return read.groupBy(lost.alias("is_rejected")).agg(F.count("*").alias("n"), F.count_if(number == "NaN").alias("n_nan"))


@query(
    "csv_tables",
    """SELECT p_partkey, p_name || chr(10) || '"' || p_brand || '", ' || p_type AS told, p_brand || ', ' || p_type AS listed FROM part""",
)
def csv_tables(spark, sf_dir):
    """Cells with quotes, commas and line breaks through the CSV sink and source; lists become text."""
    folder = _folder(spark)
    told = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", '), "p_type")
    tabular.write_csv(table(spark, sf_dir, "part").select("p_partkey", told.alias("told"), F.array("p_brand", "p_type").alias("listed")), folder, ["p_partkey"])
    return tabular.read_csv(spark, folder).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "told", "listed")


@query(
    "csv_one_file",
    """SELECT o_orderkey, '"' || o_orderstatus || '",' || chr(10) || chr(10) || o_orderpriority AS told, o_clerk FROM (SELECT o_orderkey, o_orderstatus, o_orderpriority, 'x"' || o_custkey AS o_clerk FROM orders)""",
)
def csv_one_file(spark, sf_dir):
    """One CSV file whose cells hold quotes, commas, line breaks and empty lines, read by its blocks."""
    folder = _folder(spark)
    told = F.concat(F.lit('"'), "o_orderstatus", F.lit('",\n\n'), "o_orderpriority")
    clerk = F.concat(F.lit('x"'), F.col("o_custkey").cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", told.alias("told"), clerk.alias("o_clerk"))
    rows.coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(folder)
    return tabular.read_csv(spark, folder, block_bytes=LIST_BLOCK).select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "told", "o_clerk")


@query(
    "profile_csv",
    with_ctes("""used AS (
 SELECT r_name AS db, n_name AS table_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)""")
    + "SELECT db, table_name, 'c_name|c_acctbal' AS matched, CAST(n AS VARCHAR) AS example, '25.00%' AS match_rate FROM used",
)
def profile_csv(spark, sf_dir):
    """A profile as people read it, written in table order and restored with its lists and maps."""
    folder = _folder(spark)
    counted = (
        table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
        .groupBy(F.col("r_name").alias("db"), F.col("n_name").alias("table_name")).agg(F.count("*").cast("string").alias("n"))
    )
    made = counted.select(
        "table_name", "db", names(["c_name", "c_acctbal"]).alias("matched_columns"), F.create_map(F.lit("n"), F.array("n")).alias("column_examples"), F.lit(0.25).alias("match_rate")
    )
    tabular.write_csv(tabular.printable_profile(made), folder, ["table"])
    back = tabular.read_profile(spark, folder)
    return back.select("db", "table_name", F.array_join("matched_columns", "|").alias("matched"), F.element_at("column_examples", "n")[0].alias("example"), "match_rate")


@query(
    "database_metadata",
    """SELECT r_name AS db, n_name AS table_name, 'c_' || n_nationkey AS columns, '[[1,' || r_regionkey || ']]' AS primary_keys
FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def database_metadata(spark, sf_dir):
    """Metadata of databases from JSON: ordered columns of each table, keys as text."""
    folder = _folder(spark)
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("t"))
    table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("r_name").alias("db_id"),
        F.transform("t", lambda x: x["n_name"]).alias("table_names_original"),
        F.transform("t", lambda x, i: F.array(i.cast("string"), F.concat(F.lit("c_"), x["n_nationkey"].cast("string")))).alias("column_names_original"),
        F.array(F.array(F.lit(1), F.col("r_regionkey"))).alias("primary_keys"),
        F.array().cast("array<int>").alias("foreign_keys"),
    ).write.json(folder)
    meta = tabular.read_metadata(spark, {"all": folder}, lines=True)
    listed = selection.columns_of_table(meta).select("db", "table_name", F.array_join("columns", ",").alias("columns"))
    return listed.join(meta.select("db", "primary_keys"), "db")


@query(
    "prompt_files",
    "SELECT r_name AS variant, 'Tell of ' || n_name || ' in ' || r_name AS prompt FROM nation JOIN region ON r_regionkey = n_regionkey",
)
def prompt_files(spark, sf_dir):
    """A prompt file for each region, filled for its nations."""
    folder = _folder(spark)
    regions = table(spark, sf_dir, "region")
    regions.select("r_name", F.concat(F.lit("Tell of {name} in "), "r_name").alias("value")).write.partitionBy("r_name").text(folder)
    read = tabular.read_prompt_variants(spark, folder).select(F.regexp_extract("template", r"in (\w[\w ]*)$", 1).alias("r_name"), F.rtrim(F.regexp_replace("template", r"\s+$", "")).alias("template"))
    named = table(spark, sf_dir, "nation").join(regions, F.col("r_regionkey") == F.col("n_regionkey")).join(read, "r_name")
    return named.select(F.col("r_name").alias("variant"), fill_prompt(F.col("template"), {"name": F.col("n_name")}).alias("prompt"))


@query(
    "gated_sinks",
    """SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_acctbal >= 0 THEN 'kept' ELSE 'failed' END AS outcome, c_name AS question, coalesce(n, 0) AS n_rows
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def gated_sinks(spark, sf_dir):
    """Samples whose answers are whole and those with a gap side by side, and the normalized rows, written and read back."""
    folder = _folder(spark)
    balance = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string"))
    told = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_name").alias("question"), F.array("c_mktsegment", balance).alias("flat"))
    gated = verbalize.gate_by_answer(told, "flat")
    corpus.write_gated(gated.drop("flat"), "ok", f"{folder}/gated")
    corpus.write_normalized({"samples": told, "rows": customer_rows(spark, sf_dir)}, f"{folder}/normalized")
    back = spark.read.schema("sample_id string, question string, outcome string").json(f"{folder}/gated")
    counted = spark.read.parquet(f"{folder}/normalized/rows").groupBy("sample_id").agg(F.count("*").alias("n_rows"))
    known = spark.read.parquet(f"{folder}/normalized/samples").select("sample_id")
    return back.join(known, "sample_id").join(counted, "sample_id", "left").select("sample_id", "outcome", "question", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


@query(
    "percent_texts",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.2f%%', l_discount * 100) AS share FROM lineitem",
)
def percent_texts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", percent_text(F.col("l_discount")).alias("share"))
