"""Answers of lookups and aggregates, SQL texts over the large tables, guarded replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableviews.functions import cells as cell_functions
from tableviews.functions import replies
from tableviews.operators import answers, selection, templates, verbalize
from tableviews.plans import subsets
from tableviews.session import configure, stored
from workloads.derive import (
    CUSTOMER_SAMPLES, LINE_ROWS, ORDER_ROWS, ORDER_SAMPLES, customer_rows, customer_samples, customer_tables, duck_hash, joined, order_rows,
    order_samples, order_tables, table, with_ctes,
)
from workloads.registry import query
from workloads.sentences import wide_sets
from workloads.shapes import _COUNTED, _CUSTOMER_ONLY, _TAGGED, _counted

_DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"
_LOOKUP_CTES = f"""hits AS (
 SELECT s.sample_id, o.row_pos, CASE s.ord % 8 WHEN 0 THEN CAST(o_totalprice AS VARCHAR) WHEN 1 THEN concat(o_orderkey, ' | ', {_DAY})
  WHEN 3 THEN o_orderstatus ELSE CAST(o_orderkey AS VARCHAR) END AS answer, s.ord % 8 AS shape
 FROM customer_samples s JOIN order_rows o ON o.sample_id = s.sample_id
 WHERE CASE s.ord % 8 WHEN 0 THEN o_orderstatus = 'F' WHEN 1 THEN starts_with(o_orderpriority, CAST(s.ord % 5 + 1 AS VARCHAR))
  WHEN 2 THEN o_totalprice BETWEEN 50000 AND 100000 + s.ord % 100 * 1000 WHEN 3 THEN o_orderpriority IN ('1-URGENT', '5-LOW')
  WHEN 7 THEN row_pos < 2 ELSE false END), lookups AS (
 SELECT sample_id, min(row_pos) AS row_pos, answer FROM hits GROUP BY sample_id, answer, CASE WHEN shape = 3 THEN -1 ELSE row_pos END)"""
_LOOKUPS = with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS, _LOOKUP_CTES)


def _customer(spark, sf_dir):
    return customer_samples(spark, sf_dir), customer_tables(spark, sf_dir), customer_rows(spark, sf_dir)


@query("lookup_answers", _LOOKUPS + "SELECT sample_id, CAST(row_pos AS BIGINT) AS row_pos, answer FROM lookups")
def lookup_answers(spark, sf_dir):
    """All lookups of all customers in one job."""
    found = answers.answer_lookups(*_customer(spark, sf_dir))
    return found.select("sample_id", "row_pos", joined("answer", " | ").alias("answer"))


@query(
    "nested_answers",
    _LOOKUPS + "SELECT sample_id, CAST(0 AS BIGINT) AS part, string_agg(answer, ' ; ' ORDER BY row_pos) AS answer FROM lookups GROUP BY sample_id",
)
def nested_answers(spark, sf_dir):
    parts = answers.answer_parts(answers.answer_lookups(*_customer(spark, sf_dir)))
    return parts.select("sample_id", "part", F.array_join(F.transform("answer", lambda r: F.array_join(r, " | ")), " ; ").alias("answer"))


_AGGREGATE_CTES = """groups AS (
 SELECT s.sample_id, s.ord % 8 AS shape, CASE s.ord % 8 WHEN 4 THEN o_orderpriority WHEN 5 THEN o_orderstatus END AS group_value,
  CASE WHEN any_value(s.ord) % 8 = 6 THEN max(o_totalprice) ELSE CAST(count(*) AS DOUBLE) END AS value
 FROM customer_samples s JOIN orders o ON o.o_custkey = s.ord
 WHERE s.ord % 8 IN (4, 5) OR (s.ord % 8 = 6 AND o_orderstatus = 'O') GROUP BY 1, 2, 3), kept AS (
 SELECT * FROM groups QUALIFY shape <> 5 OR row_number() OVER (PARTITION BY sample_id ORDER BY value DESC, group_value) = 1), aggregates AS (
 SELECT sample_id, group_value, value, CASE shape WHEN 4 THEN concat(group_value, ' | ', CAST(value AS BIGINT)) WHEN 5 THEN group_value
  ELSE CAST(value AS VARCHAR) END AS answer FROM kept
 UNION ALL SELECT sample_id, NULL, NULL, NULL FROM customer_samples s WHERE ord % 8 = 6
  AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.sample_id = s.sample_id))"""
_AGGREGATES = with_ctes(CUSTOMER_SAMPLES, _AGGREGATE_CTES)
_BOTH = with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS, _LOOKUP_CTES, _AGGREGATE_CTES).rstrip()


@query("aggregate_answers", _AGGREGATES + "SELECT sample_id, group_value, value, coalesce(answer, 'none') AS answer FROM aggregates")
def aggregate_answers(spark, sf_dir):
    """All single-table aggregates of all customers in one job."""
    found = answers.answer_aggregates(*_customer(spark, sf_dir))
    return found.select("sample_id", "group_value", "value", F.coalesce(F.array_join("answer", " | ", "none"), F.lit("none")).alias("answer"))


@query(
    "answer_quality",
    _BOTH + """,
 vals AS (SELECT sample_id, answer AS v FROM aggregates WHERE group_value IS NULL UNION ALL SELECT sample_id, unnest(string_split(answer, ' | ')) FROM aggregates WHERE group_value IS NOT NULL
  UNION ALL SELECT sample_id, unnest(string_split(answer, ' | ')) FROM lookups)
SELECT sample_id, count(*) AS n_values, count(*) FILTER (v IS NULL) = 0 AS ok,
 count(*) FILTER (v <> '') > 0 AND NOT (count(*) = 1 AND count(*) FILTER (TRY_CAST(v AS DOUBLE) = 0) = 1) AS meaningful
FROM vals GROUP BY sample_id""",
)
def answer_quality(spark, sf_dir):
    """Whether the answers are complete and say something, over lookups and aggregates."""
    return answers.answer_quality(answers.recompute_answers(*_customer(spark, sf_dir)))


@query(
    "answered_subset",
    with_ctes(
        CUSTOMER_SAMPLES, ORDER_ROWS, _CUSTOMER_ONLY, _TAGGED, _COUNTED, _LOOKUP_CTES,
        "vals AS (SELECT sample_id, unnest(string_split(answer, ' | ')) AS v FROM lookups)",
        """good AS (SELECT sample_id FROM vals GROUP BY sample_id
 HAVING count(*) FILTER (v <> '') > 0 AND NOT (count(*) = 1 AND count(*) FILTER (TRY_CAST(v AS DOUBLE) = 0) = 1))""",
    )
    + """SELECT sample_id, sql_type, CASE WHEN n_rows <= 10 THEN 'short_' ELSE 'long_' END ||
 CASE WHEN sql_type = 'SimpleProjection' THEN 'lookup' ELSE 'compositional' END AS subset
FROM counted WHERE sql_type <> '' AND sample_id IN (SELECT sample_id FROM good)""",
)
def answered_subset(spark, sf_dir):
    """Questions of all subsets whose lookup gives an answer that says something."""
    labelled = _counted(spark, sf_dir).withColumn("subset", selection.subset_label(short_max=10, long_min=11)).filter(F.col("subset").isNotNull())
    quality = answers.answer_quality(answers.answer_lookups(*_customer(spark, sf_dir)))
    return subsets.answered_subset(labelled, quality).select("sample_id", "sql_type", "subset")


@query(
    "recompute_answers",
    with_ctes(ORDER_SAMPLES, LINE_ROWS, f"""chosen AS (
 SELECT sample_id, ord, CASE WHEN db NOT LIKE '3%' THEN {duck_hash(42, 'sample_id', '0')} % 2 END AS set_no FROM order_samples), complete AS (
 SELECT r.*, o.o_orderstatus, c.ord % 6 AS shape FROM line_rows r JOIN chosen c ON c.sample_id = r.sample_id JOIN orders o ON o.o_orderkey = c.ord
 WHERE c.set_no = 1 OR (c.set_no = 0 AND l_partkey % 4 <> 0))""") + """
SELECT sample_id, CAST(row_pos AS BIGINT) AS row_pos, CASE shape WHEN 0 THEN CAST(l_extendedprice AS VARCHAR) WHEN 1 THEN CASE WHEN l_partkey % 4 = 0 THEN 'none' ELSE l_returnflag END
 ELSE concat(l_quantity, ' | ', l_tax) END AS answer FROM complete
WHERE (shape IN (0, 2) AND l_linestatus = o_orderstatus) OR (shape = 1 AND l_linenumber = l_orderkey % 7 + 1)
UNION ALL SELECT sample_id, 0, coalesce((SELECT CAST(sum(l_quantity) AS VARCHAR) FROM complete k WHERE k.sample_id = s.sample_id AND l_linestatus = o_orderstatus), 'none')
FROM (SELECT * FROM order_samples JOIN orders ON o_orderkey = ord) s WHERE ord % 6 = 3""",
)
def recompute_answers(spark, sf_dir):
    """Answers on the complete rows only, after incomplete ones were dropped for verbalization."""
    tables = order_tables(spark, sf_dir)
    chosen = verbalize.choose_template_sets(tables, templates.template_sets(wide_sets(spark, sf_dir)))
    # the raw version is a table of its own, read by lookups and by aggregates
    raw = stored(verbalize.complete_rows(order_rows(spark, sf_dir, nulls=True), chosen).select("sample_id", "table_pos", "row_pos", "n_rows", "cells"))
    again = answers.recompute_answers(order_samples(spark, sf_dir), tables, raw)
    return again.select("sample_id", "row_pos", F.array_join("answer", " | ", "none").alias("answer"))


@query(
    "answer_status",
    with_ctes(ORDER_SAMPLES, LINE_ROWS) + """
SELECT s.sample_id, CASE WHEN ord % 6 IN (4, 5) THEN 'not supported' WHEN ord % 6 = 3 OR coalesce(n, 0) > 0 THEN 'answered' ELSE 'empty' END AS status,
 CASE WHEN ord % 6 = 3 THEN 1 WHEN ord % 6 IN (4, 5) THEN 0 ELSE coalesce(n, 0) END AS n_answer_rows
FROM order_samples s LEFT JOIN (
 SELECT l.sample_id, count(*) AS n FROM line_rows l JOIN orders ON o_orderkey = l_orderkey
 WHERE CASE l_orderkey % 6 WHEN 1 THEN l_linenumber = l_orderkey % 7 + 1 ELSE l_linestatus = o_orderstatus END GROUP BY l.sample_id) h
ON h.sample_id = s.sample_id""",
)
def answer_status(spark, sf_dir):
    """What became of every sample of the order corpus, in all its six shapes."""
    tables, samples = order_tables(spark, sf_dir), order_samples(spark, sf_dir)
    specs = answers.specs_of(samples, tables)
    found = answers.recompute_answers(samples, tables, order_rows(spark, sf_dir), specs)
    return answers.answer_status(samples, tables, found, specs)


# Texts over the large tables; the last one names a column that does not exist.
WORKLOAD = [
    ("customers_per_segment", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment;"),
    ("urgent_orders", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000"),
    ("nation_region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    ("part_brands", "SELECT p_brand, min(p_size) AS low, max(p_size) AS high FROM part GROUP BY p_brand"),
    ("late_lines", "SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey HAVING sum(l_quantity) > 100"),
    ("same_names", "SELECT a.r_name, b.r_name, CAST(NULL AS INT) AS gap FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey"),
    ("ranked", "SELECT n_name FROM nation ORDER BY n_name DESC"),
    ("divided", "SELECT 1 / (n_regionkey - n_regionkey) AS x FROM nation"),
    ("dropped", "DROP VIEW nation"),
    ("broken", "SELECT no_such_column FROM orders"),
]
# What becomes of the texts that fail.
_FAILING = {"divided": "DIVIDE_BY_ZERO", "dropped": "Only SELECT is allowed.", "broken": "UNRESOLVED_COLUMN.WITH_SUGGESTION"}


def _done(spark, sf_dir):
    """The texts run in a session of their own, so that views of the user's session stay."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    configure(own)
    for name in ("customer", "orders", "nation", "region", "part", "lineitem"):
        table(own, sf_dir, name).createOrReplaceTempView(name)
    return answers.run_workload(own, WORKLOAD)


def _duck_workload() -> str:
    parts = []
    keys = {
        "customers_per_segment": "c_mktsegment || '/' || n", "urgent_orders": "CAST(o_orderkey AS VARCHAR)",
        "nation_region": "n_name || '/' || r_name", "part_brands": "p_brand || '/' || low || '/' || high",
        "late_lines": "l_orderkey || '/' || CAST(q AS VARCHAR)", "same_names": "r_name || '/' || r_name_1 || '/none'", "ranked": "n_name",
    }
    for name, text in WORKLOAD:
        inner = text.rstrip(";").replace("a.r_name, b.r_name", "a.r_name, b.r_name AS r_name_1")
        if name in _FAILING:
            parts.append(f"SELECT '{name}', CAST(NULL AS BIGINT), 'none', '{_FAILING[name]}'")
            continue
        place = "row_number() OVER (ORDER BY n_name DESC) - 1" if name == "ranked" else "CAST(NULL AS BIGINT)"
        parts.append(f"SELECT '{name}' AS query_id, {place} AS row_pos, {keys[name]} AS row_text, 'none' AS error FROM ({inner})")
    return " UNION ALL ".join(parts)


@query("workload", _duck_workload())
def workload(spark, sf_dir):
    """Each text run on its own, all results in one table; a text that fails or is no SELECT is a row with its error."""
    done = _done(spark, sf_dir)
    fields = F.from_json("row_json", "map<string,string>")
    text = F.array_join(F.map_values(fields), "/", "none")
    return done.select("query_id", "row_pos", F.coalesce(text, F.lit("none")).alias("row_text"), F.coalesce("error", F.lit("none")).alias("error"))


@query(
    "workload_outcomes",
    "SELECT (SELECT count(*) FROM (" + _duck_workload() + ") WHERE error = 'none') AS n_ok, " + str(len(_FAILING)) + " AS n_failed",
)
def workload_outcomes(spark, sf_dir):
    from tableviews.operators.scoring import outcome_counts

    return outcome_counts(_done(spark, sf_dir))


# Text-to-SQL replies: fenced, bare, with brackets, with a note, and statements that are no SELECT.
_REPLY = """CASE o_orderkey % 6
 WHEN 0 THEN concat('Sure:\n```sql\nSELECT ', o_orderkey, ';\n```\nDone.')
 WHEN 1 THEN concat('select ', o_orderkey, ' ;;')
 WHEN 2 THEN concat('( SELECT ', o_orderkey, ')<!--note--> guessed the year ')
 WHEN 3 THEN concat('WITH x AS (SELECT ', o_orderkey, ') SELECT * FROM x')
 WHEN 4 THEN concat('```SQL SELECT ', o_orderkey, ' FROM t``` <!--NOTE-->  two\nlines')
 ELSE concat('DELETE FROM t WHERE k = ', o_orderkey) END"""


@query(
    "sql_guard",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat('SELECT ', o_orderkey, ';') WHEN 1 THEN concat('select ', o_orderkey, ' ;')
 WHEN 2 THEN concat('( SELECT ', o_orderkey, ');') WHEN 4 THEN concat('SELECT ', o_orderkey, ' FROM t;') END AS sql,
 CASE WHEN o_orderkey % 6 IN (3, 5) THEN 'Only SELECT is allowed.' END AS error FROM orders""",
)
def sql_guard(spark, sf_dir):
    reply = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_REPLY).alias("reply"))
    return reply.select("o_orderkey", replies.guard_sql(replies.sql_without_note(F.col("reply"))).alias("g")).select("o_orderkey", "g.sql", "g.error")


@query(
    "sql_notes",
    r"""WITH r AS (SELECT o_orderkey, """ + _REPLY.replace("'\\n", "E'\\n") + r""" AS reply FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'guessed the year' WHEN 4 THEN 'two' || chr(10) || 'lines' END AS note FROM r""",
)
def sql_notes(spark, sf_dir):
    reply = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_REPLY).alias("reply"))
    return reply.select("o_orderkey", replies.sql_note(F.col("reply")).alias("note"))


@query(
    "single_cell_answers",
    "SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_custkey % 3 = 1 THEN c_name END AS prediction FROM customer",
)
def single_cell_answers(spark, sf_dir):
    """A one-by-one result collapses to its cell; other shapes do not."""
    shaped = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("sample_id"),
        F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<array<string>>"))
        .when(F.col("c_custkey") % 3 == 1, F.array(F.array("c_name")))
        .otherwise(F.array(F.array("c_name", "c_mktsegment"))).alias("rows"),
    )
    return shaped.select("sample_id", cell_functions.collapse_single(F.col("rows")).alias("prediction"))
