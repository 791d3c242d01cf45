"""Rendered tables and requests, and what comes back for columns and templates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tableviews.functions import markdown, replies, text, wording
from tableviews.operators import exchange, ledger, profile, prompts, reshape, templates
from tableviews.operators.markdown_rows import markdown_rows
from tableviews.plans import evaluation
from tableviews.session import checkpoint_folder
from workloads.derive import (
    CUSTOMER_SAMPLES, ORDER_COLUMNS, ORDER_ROWS, customer_rows, customer_samples, customer_tables, joined, names, spread_table, table, with_ctes,
)
from workloads.registry import query


def quoted(x: str) -> str:
    """String literal for DuckDB."""
    return "'" + x.replace("'", "''") + "'"


def filled(template: str, **values: str) -> str:
    """DuckDB expression for a template: single braces are filled, doubled ones become single."""
    out = quoted(template.replace("{{", "\x01").replace("}}", "\x02"))
    for name, expr in values.items():
        out = f"replace({out}, '{{{name}}}', {expr})"
    return f"replace(replace({out}, '\x01', '{{'), '\x02', '}}')"


_HEAD = "| " + " | ".join(ORDER_COLUMNS) + " |\n" + "| " + " | ".join(["---"] * 5) + " |"
_RENDERED = f"""rendered AS (
 SELECT s.sample_id, s.question, concat({quoted("### Table: orders" + chr(10) + chr(10) + _HEAD)}, coalesce(chr(10) || string_agg('| ' || array_to_string(cells, ' | ') || ' |', chr(10) ORDER BY row_pos), '')) AS markdown
 FROM customer_samples s LEFT JOIN order_rows o ON o.sample_id = s.sample_id GROUP BY s.sample_id, s.question)"""


@query("markdown_render", with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS, _RENDERED) + "SELECT sample_id, CAST(0 AS BIGINT) AS part, markdown FROM rendered")
def markdown_render(spark, sf_dir):
    return prompts.render_tables(customer_rows(spark, sf_dir), customer_tables(spark, sf_dir)).select("sample_id", "part", "markdown")


@query(
    "markdown_multi_header",
    """SELECT n_nationkey, concat(chr(10), '| ', CASE WHEN n_nationkey % 2 = 0 THEN ' ' ELSE n_name END, ' | b |', chr(10), '| c |  |', chr(10), '| --- | --- |') AS head
FROM nation JOIN customer ON c_nationkey = n_nationkey""".replace("| c |  |", "| c |   |"),
)
def markdown_multi_header(spark, sf_dir):
    """Header of two rows; empty names are shown as a blank, no table name leaves an empty line."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    first = F.array(F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("n_name")), F.lit("b"))
    rows = F.array(first, F.array(F.lit("c"), F.lit("")))
    return nations.select("n_nationkey", markdown.table_head_multi(F.lit(None).cast("string"), rows).alias("head"))


# Turns of one customer service record stand for the text segments: each customer's first order day.
def _segments(spark, sf_dir):
    told = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.col("o_orderdate").cast("date").cast("string")).alias("day"))
    return told.select(
        F.col("o_custkey").cast("string").alias("sample_id"), F.lit(0).alias("table_pos"), F.lit(0).cast("bigint").alias("part"),
        F.concat(F.lit("The first order was placed on "), "day", F.lit(".")).alias("text"),
    )


BUDGET = 240
_W = wording


def _duck_view(view: str) -> str:
    tables = f"concat({quoted(_W.QA_TABLES_MARK)}, markdown, chr(10), chr(10))"
    extra = f"concat({quoted(_W.QA_EXTRA_MARK)}, texts, chr(10), chr(10))"
    only = f"concat({quoted(_W.QA_TEXT_MARK)}, texts, chr(10), chr(10))"
    asked = f"concat({quoted(_W.QA_QUESTION_MARK)}, question, chr(10), chr(10), {quoted(_W.QA_ENDING)})"
    parts = {
        "semi-structured": [quoted(_W.QA_TABLE_INTRO), tables, extra, asked],
        "structured": [quoted(_W.QA_TABLE_INTRO), tables, asked],
        "unstructured": [quoted(_W.QA_TEXT_INTRO), only, asked],
    }[view]
    return f"SELECT sample_id, '{view}' AS view, concat({', '.join(parts)}) AS prompt FROM said"


_VIEWS = with_ctes(
    CUSTOMER_SAMPLES, ORDER_ROWS, _RENDERED,
    """said AS (SELECT r.*, coalesce('The first order was placed on ' || day || '.', '') AS texts FROM rendered r LEFT JOIN
 (SELECT CAST(o_custkey AS VARCHAR) AS k, min(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) AS day FROM orders GROUP BY o_custkey) ON k = sample_id)""",
    "views AS (" + " UNION ALL ".join(_duck_view(v) for v in _W.QA_VIEWS) + ")",
    "sized AS (SELECT *, CAST(ceil(length(prompt) / 4.0) AS BIGINT) AS n_tokens_est FROM views)",
)


@query(
    "prompt_views",
    _VIEWS + f"""SELECT sample_id, view, n_tokens_est, prompt, CASE WHEN n_tokens_est > {BUDGET} THEN 'prompt_too_long' END AS error FROM sized""",
)
def prompt_views(spark, sf_dir):
    """Three whole views per sample; those beyond the budget are marked."""
    return prompts.qa_views(
        customer_samples(spark, sf_dir), customer_tables(spark, sf_dir), customer_rows(spark, sf_dir), _segments(spark, sf_dir), budget=BUDGET
    )


@query(
    "answered_views",
    _VIEWS + """SELECT view, count(*) AS n, 0 AS n_skipped, count(*) FILTER (CAST(sample_id AS BIGINT) % 3 = 1) AS em,
 count(*) FILTER (CAST(sample_id AS BIGINT) % 3 <> 0) AS pm,
 count(*) FILTER (CAST(sample_id AS BIGINT) % 3 = 0) AS n_silent FROM sized GROUP BY view""",
)
def answered_views(spark, sf_dir):
    """Requests, replies and scores of a whole run, per view."""
    samples = customer_samples(spark, sf_dir).withColumn("answer", F.parse_json(F.concat(F.lit('[["Nr '), "sample_id", F.lit('"]]'))))
    views = prompts.qa_views(samples, customer_tables(spark, sf_dir), customer_rows(spark, sf_dir), _segments(spark, sf_dir))
    requests = evaluation.qa_requests(views)
    third = F.col("sample_id").cast("bigint") % 3
    answered = requests.filter(third != 0).select(
        "request_id", F.concat(F.lit('{"Answer": "'), F.when(third == 1, "nr ").otherwise(""), "sample_id", F.lit('"}')).alias("text")
    )
    results = evaluation.qa_results(views, samples, answered)
    skipped, silent = F.col("error") == prompts.TOO_LONG, F.col("error") == exchange.NO_REPLY
    return results.groupBy("view").agg(
        F.count("*").alias("n"), F.count_if(skipped).alias("n_skipped"), F.sum("em").alias("em"), F.sum("pm").alias("pm"),
        F.count_if(silent).alias("n_silent"),
    )


_PREVIEW = with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS, """previews AS (
 SELECT s.sample_id, s.question, concat('Table orders', chr(10), '| ', CASE WHEN count(o.sample_id) = 0 THEN
  'o_orderkey (TEXT) | o_orderstatus (TEXT) | o_totalprice (TEXT) | o_orderdate (TEXT) | o_orderpriority (TEXT)' ELSE
  'o_orderkey (INTEGER) | o_orderstatus (TEXT) | o_totalprice (REAL) | o_orderdate (TEXT) | o_orderpriority (TEXT)' END,
  ' |', chr(10), '| --- | --- | --- | --- | --- |', chr(10),
  coalesce(string_agg('| ' || array_to_string(cells, ' | ') || ' |', chr(10) ORDER BY row_pos) FILTER (row_pos < 3), '')) AS schema_md
 FROM customer_samples s LEFT JOIN order_rows o ON o.sample_id = s.sample_id GROUP BY s.sample_id, s.question)""")


def _previews(spark, sf_dir):
    rows, tables = customer_rows(spark, sf_dir), customer_tables(spark, sf_dir)
    return prompts.schema_previews(rows, tables, reshape.cells_of(rows, tables))


@query("schema_previews", _PREVIEW + "SELECT sample_id, schema_md FROM previews")
def schema_previews(spark, sf_dir):
    return _previews(spark, sf_dir)


@query(
    "sql_requests",
    _PREVIEW + f"""SELECT sample_id, {filled(_W.SQL_SYSTEM, dialect="'Spark SQL'")} AS system,
 {filled(_W.SQL_USER, dialect="'Spark SQL'", schema_md="schema_md", question="question", today="'2025-01-31'")} AS asked,
 concat('```sql', chr(10), 'SELECT x', chr(10), '```') AS tried, {filled(_W.SQL_REPAIR, dialect="'Spark SQL'", error="'no column x'")} AS repair FROM previews""",
)
def sql_requests(spark, sf_dir):
    """Text-to-SQL messages, and the second round after an error."""
    asked = customer_samples(spark, sf_dir).join(_previews(spark, sf_dir), "sample_id", "left")
    first = asked.withColumn("m", prompts.sql_messages(F.col("schema_md"), F.col("question"), "2025-01-31", "Spark SQL"))
    second = first.withColumn("m", prompts.repair_messages(F.col("m"), F.lit(" SELECT x "), F.lit("no column x"), "Spark SQL"))
    said = lambda i: F.get("m", F.lit(i))["content"]
    return second.select("sample_id", said(0).alias("system"), said(1).alias("asked"), said(2).alias("tried"), said(3).alias("repair"))


@query(
    "judge_requests",
    f"SELECT doc_id, {filled(_W.JUDGE, truth='lang', prediction='source')} AS prompt FROM documents",
)
def judge_requests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", prompts.judge_prompt(F.col("source"), F.col("lang")).alias("prompt"))


@query("enrichment_requests", f"SELECT p_partkey, {filled(_W.ENRICHMENT_REQUEST, row='p_brand', description='p_name')} AS prompt FROM part")
def enrichment_requests(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", prompts.enrichment_prompt(F.col("p_brand"), F.col("p_name")).alias("prompt"))


# Column use and examples of the customer corpus; the examples are the first values of the first customer.
_PROFILE = with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS, f"""columns AS (SELECT unnest({[c for c in ORDER_COLUMNS]}) AS c, unnest(range(1, 6)) AS i), used AS (
 SELECT db, c, i, bool_or(contains(lower(sql), c)) AS used FROM customer_samples CROSS JOIN columns GROUP BY ALL), firsts AS (
 SELECT db, min(ord) AS ord FROM customer_samples GROUP BY db), vals AS (
 SELECT db, c, cells[i] AS value, min(row_pos) AS row_pos FROM firsts JOIN order_rows o ON o.o_custkey = ord CROSS JOIN columns GROUP BY ALL), examples AS (
 SELECT db, c, array_agg(value ORDER BY row_pos) AS ex FROM (SELECT * FROM vals QUALIFY row_number() OVER (PARTITION BY db, c ORDER BY row_pos) <= 3) GROUP BY ALL), shown AS (
 SELECT u.db, u.c, u.used, coalesce(e.ex, []) AS ex FROM used u LEFT JOIN examples e ON e.db = u.db AND e.c = u.c)""")


def _profile(spark, sf_dir):
    rows, tables = customer_rows(spark, sf_dir), customer_tables(spark, sf_dir)
    examples = profile.examples_map(profile.column_examples(rows, tables))
    return profile.column_usage(tables).join(examples, ["db", "table_name"])


@query(
    "column_requests",
    _PROFILE.rstrip() + ",\n" + """asked AS (SELECT db, string_agg(CASE WHEN len(ex) > 0 THEN c || ' (' || array_to_string(ex, ', ') || ')' ELSE c END, chr(10) ORDER BY c) AS cols FROM shown GROUP BY db),
rules AS (SELECT unnest([""" + ", ".join(quoted(k) for k in _W.COMBINATION_RULES) + "]) AS variant, unnest([" + ", ".join(quoted(v) for v in _W.COMBINATION_RULES.values()) + f"""]) AS rule)
SELECT db, variant, {filled(_W.COLUMN_REQUEST, rule="rule", db="db", table="'orders'", cols="cols")} AS prompt FROM asked CROSS JOIN rules""",
)
def column_requests(spark, sf_dir):
    """One prompt per table and combination rule, over all columns with their examples."""
    made = prompts.column_requests(_profile(spark, sf_dir), templates.columns_in_scope("all"))
    return made.select("db", "variant", "prompt")


@query(
    "column_scopes",
    _PROFILE + """SELECT db, string_agg(c, ',' ORDER BY c) AS every, coalesce(string_agg(c, ',' ORDER BY c) FILTER (used), '') AS only_used,
 coalesce(string_agg(c, ',' ORDER BY c) FILTER (NOT used), '') AS only_unused, string_agg(c, ',' ORDER BY NOT used, c) AS used_first FROM shown GROUP BY db""",
)
def column_scopes(spark, sf_dir):
    scope = lambda s: joined(templates.columns_in_scope(s), ",")
    return _profile(spark, sf_dir).select(
        "db", scope("all").alias("every"), scope("query").alias("only_used"), scope("other").alias("only_unused"),
        joined(templates.columns_to_verbalize(), ",").alias("used_first"),
    )


@query(
    "template_requests",
    _PROFILE.rstrip() + ",\n" + f"""asked AS (SELECT db, string_agg(CASE WHEN c IN ('o_orderkey', 'o_orderdate') THEN '[SELECTED] ' ELSE '' END || c || ': ' || array_to_string(ex, ', '), chr(10) ORDER BY c) FILTER (len(ex) > 0) AS block FROM shown GROUP BY db)
SELECT db, {filled(_W.TEMPLATE_REQUEST, db="db", table="'orders'", sel_cols="'o_orderkey, o_orderdate'", example_block="coalesce(block, '')")} AS prompt FROM asked""",
)
def template_requests(spark, sf_dir):
    """Prompts for a combination of two columns, with the examples of all columns around it."""
    profiled = _profile(spark, sf_dir)
    combos = profiled.select("db", "table_name", names(["o_orderkey", "o_orderdate"]).alias("columns"))
    return prompts.template_requests(combos, profiled.select("db", "table_name", "column_examples")).select("db", "prompt")


# Label replies: fenced, bare, list at the top, cut off, upper-case fence, odd elements.
_LABELS = """CASE o_orderkey % 6
 WHEN 0 THEN concat('Here:', chr(10), '```json', chr(10), '{"column_classification": {"a": "YES", "b": "yes", "c": "NO"}, "combinations": [["a", "b"], ["a", "c"], []]}', chr(10), '```')
 WHEN 1 THEN concat(' {"column_classification": {"k', CAST(o_orderkey AS STRING), '": "Yes"}, "combinations": [["k', CAST(o_orderkey AS STRING), '"], ["zz"]]} ')
 WHEN 2 THEN '[{"column_classification": {"a": "YES"}, "combinations": [["a"]]}, {"column_classification": {"b": "YES"}}]'
 WHEN 3 THEN '```json {"column_classification": {"a": '
 WHEN 4 THEN concat('```JSON', chr(10), '{"column_classification": {"a": "YES"}}', chr(10), '```')
 ELSE '{"column_classification": {"a": true, "7": "YES"}, "combinations": [[7, 1.5, null], "x", ["a", 7]]}' END"""


def _label_replies(spark, sf_dir):
    replied = spread_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("db"), F.lit("t").alias("table_name"), F.expr(_LABELS).alias("text")
    )
    return templates.parse_labels(replied)


_LABEL_ROWS = """label_rows AS (SELECT CAST(o_orderkey AS VARCHAR) AS db, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['a', 'b', 'c'] WHEN 1 THEN [concat('k', o_orderkey)]
 WHEN 2 THEN ['a'] WHEN 5 THEN ['a', '7'] ELSE [] END) AS label_column, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['YES', 'yes', 'NO'] WHEN 1 THEN ['Yes'] WHEN 2 THEN ['YES']
 WHEN 5 THEN ['True', 'YES'] ELSE [] END) AS label FROM orders)"""


@query("parse_labels", f"WITH {_LABEL_ROWS} SELECT * FROM label_rows")
def parse_labels(spark, sf_dir):
    return templates.label_rows(_label_replies(spark, sf_dir)).select("db", F.col("column").alias("label_column"), "label")


@query("label_failures", "SELECT CAST(o_orderkey AS VARCHAR) AS db, length(" + _LABELS.replace("AS STRING", "AS VARCHAR") + ") AS n_chars FROM orders WHERE o_orderkey % 6 IN (3, 4)")
def label_failures(spark, sf_dir):
    return templates.label_failures(_label_replies(spark, sf_dir)).select("db", F.length("output").alias("n_chars"))


@query(
    "yes_combinations",
    """SELECT CAST(o_orderkey AS VARCHAR) AS db, unnest(CASE o_orderkey % 6 WHEN 0 THEN ['a,b'] WHEN 1 THEN [concat('k', o_orderkey)] WHEN 2 THEN ['a'] WHEN 5 THEN ['7'] ELSE [] END) AS columns FROM orders""",
)
def yes_combinations(spark, sf_dir):
    return templates.combination_rows(_label_replies(spark, sf_dir)).select("db", joined("columns", ",").alias("columns"))


_WIDE = """wide AS (SELECT CAST(o_orderkey AS VARCHAR) AS db, unnest(CASE o_orderkey % 6 WHEN 0 THEN [{'a': 'a', 'b': 'b'}] WHEN 1 THEN [{'a': concat('k', o_orderkey), 'b': ''}]
 WHEN 2 THEN [{'a': 'a', 'b': ''}] WHEN 5 THEN [{'a': '7', 'b': ''}] ELSE [] END) AS w FROM orders)"""


@query("widen_combinations", f"WITH {_WIDE} SELECT db, w.a AS column1, w.b AS column2, '' AS column3 FROM wide")
def widen_combinations(spark, sf_dir):
    return templates.widen(templates.combination_rows(_label_replies(spark, sf_dir)), 3).drop("table_name")


@query("widest_combination", "SELECT 2 AS n_columns FROM orders LIMIT 1")
def widest_combination(spark, sf_dir):
    return templates.widest(templates.combination_rows(_label_replies(spark, sf_dir)))


# Template replies: fenced, without fence and with a gap, no object, silence.
_TEMPLATES = """CASE o_orderkey % 4
 WHEN 0 THEN concat('```json', chr(10), '{"template1": "A {x} ', o_orderstatus, '", "template2": "B {x}", "template3": "C {x}", "template4": "D {x}", "template5": "E {x}"}', chr(10), '```')
 WHEN 1 THEN concat('``` {"template1": "A {x} ', o_orderstatus, '", "template3": "C {x}"} ```')
 WHEN 2 THEN '["template1"]' END"""


@query(
    "fill_templates",
    """SELECT CAST(o_orderkey AS VARCHAR) AS db, 'x' AS column1, CASE WHEN o_orderkey % 4 IN (0, 1) THEN concat('A {x} ', o_orderstatus) ELSE 'ERROR' END AS template1,
 CASE WHEN o_orderkey % 4 = 0 THEN 'B {x}' ELSE 'ERROR' END AS template2, CASE WHEN o_orderkey % 4 IN (0, 1) THEN 'C {x}' ELSE 'ERROR' END AS template3,
 CASE WHEN o_orderkey % 4 = 0 THEN 'D {x}' ELSE 'ERROR' END AS template4, CASE WHEN o_orderkey % 4 = 0 THEN 'E {x}' ELSE 'ERROR' END AS template5 FROM orders""",
)
def fill_templates(spark, sf_dir):
    replied = spread_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("db"), F.lit("t").alias("table_name"), F.lit("x").alias("column1"), F.expr(_TEMPLATES).alias("text")
    )
    return templates.ensure_template_columns(templates.attach_templates(replied).drop("text")).drop("table_name")


@query(
    "list_fields",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN concat(o_orderstatus, '|', o_orderkey) WHEN 2 THEN '[a|b' ELSE '' END AS items FROM orders""",
)
def list_fields(spark, sf_dir):
    field = """CASE o_orderkey % 4 WHEN 0 THEN ' a , ,b ' WHEN 1 THEN concat('["', o_orderstatus, ' ", ', CAST(o_orderkey AS STRING), ', " "]') WHEN 2 THEN '[a, b' END"""
    return table(spark, sf_dir, "orders").select("o_orderkey", joined(replies.parse_list_field(F.expr(field)), "|").alias("items"))


@query(
    "template_placeholders",
    """SELECT p_partkey, 'p_name,p_brand' AS found, p_size % 2 = 0 AS fits, concat('The ', p_name, ' is a {p_brand} of ', p_brand, '.') AS sentence FROM part""",
)
def template_placeholders(spark, sf_dir):
    """Names in a template, and a value that itself looks like a later placeholder."""
    template = F.lit("The {p_name} of {p_brand}.")
    wanted = F.when(F.col("p_size") % 2 == 0, names(["p_brand", "p_name"])).otherwise(names(["p_brand"]))
    value = F.concat("p_name", F.lit(" is a [p_brand]"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        joined(text.placeholders(template), ",").alias("found"),
        text.template_fits(template, wanted).alias("fits"),
        F.translate(text.fill_template(template, names(["p_name", "p_brand"]), F.array(value, F.col("p_brand"))), "[]", "{}").alias("sentence"),
    )


@query(
    "markdown_rows",
    r"""WITH lines AS (SELECT doc_id, string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)) AS ls FROM documents),
heads AS (SELECT doc_id, ls, list_transform(string_split(trim(ls[1], '|'), '|'), lambda x: trim(x)) AS h FROM lines WHERE len(ls) >= 2),
body AS (SELECT doc_id, h, unnest(ls[3:]) AS l FROM heads), cut AS (SELECT doc_id, h, list_transform(string_split(trim(l, '|'), '|'), lambda x: trim(x)) AS c FROM body)
SELECT doc_id, len(h) AS n_columns, array_to_string(c, '~') AS cells FROM cut WHERE len(c) = len(h)""",
)
def markdown_table_rows(spark, sf_dir):
    """Markdown tables in texts: header, and the rows of the same arity."""
    parsed = table(spark, sf_dir, "documents").select("doc_id", markdown.parse_table(F.col("text")).alias("t"))
    return parsed.select("doc_id", F.size("t.columns").alias("n_columns"), F.explode_outer("t.rows").alias("r")).filter(F.col("r").isNotNull()).select(
        "doc_id", "n_columns", joined("r", "~").alias("cells")
    )


@query(
    "markdown_part_rows",
    with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS) + """SELECT sample_id AS table_id, row_pos, count(*) OVER (PARTITION BY sample_id) AS n_rows, array_to_string(cells, '~') AS cells FROM order_rows""",
)
def markdown_part_rows(spark, sf_dir):
    """Rendered tables in parts of four rows, back to rows without putting a table together."""
    parts = prompts.render_tables(customer_rows(spark, sf_dir), customer_tables(spark, sf_dir), rows_per_part=4)
    plain = parts.select("sample_id", "part", F.regexp_replace("markdown", r"^### Table: \w+\n\n", "").alias("markdown"))
    rows = markdown_rows(plain, "sample_id")
    return rows.select(F.col("sample_id").alias("table_id"), "row_pos", "n_rows", joined("cells", "~").alias("cells"))


@query(
    "markdown_subset",
    with_ctes(CUSTOMER_SAMPLES, ORDER_ROWS)
    + """SELECT s.sample_id, 'Orders of ' || c_name AS table_name, c_mktsegment AS struct_type, CAST(n AS BIGINT) AS n_rows, c_name AS answer, s.question
FROM customer_samples s JOIN customer ON c_custkey = ord JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = ord
WHERE c_mktsegment NOT IN ('MACHINERY', 'BUILDING') AND n BETWEEN 3 AND 12 AND ord % 4 <> 1""",
)
def markdown_subset(spark, sf_dir):
    """Simple questions on flat, short Markdown tables."""
    from tableviews.plans import subsets

    rendered = prompts.render_tables(customer_rows(spark, sf_dir), customer_tables(spark, sf_dir).withColumn("table_name", F.lit(None).cast("string")))
    customers = table(spark, sf_dir, "customer").withColumn("sample_id", F.col("c_custkey").cast("string"))
    meta = customers.join(rendered, "sample_id").select(
        F.col("sample_id").alias("table_id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("struct_type"), "markdown",
        F.array(F.lit(" Orders of ")).alias("pre_context"), F.array("c_name").alias("post_context"),
    )
    golden = F.when(F.col("c_custkey") % 4 == 1, F.lit("[]")).otherwise(
        F.concat(F.lit('[{"' + subsets.ANSWER_LIST + '": [{"' + subsets.FINAL_ANSWER + '": ["'), "c_name", F.lit('"]}]}]'))
    )
    questions = customers.select(
        "sample_id", F.col("sample_id").alias("table_id"), F.lit(subsets.SIMPLE_TASK).alias("sub_task"),
        F.array(F.concat(F.lit("What did "), "c_name", F.lit(" order?"))).alias("questions"), F.parse_json(golden).alias("golden"),
    )
    kept = subsets.markdown_subset(questions, meta, 3, 12, excluded=["MACHINERY", "BUILDING"])
    return kept.select("sample_id", "table_name", "struct_type", "n_rows", "answer", "question")


@query(
    "catalog_subsets",
    with_ctes(CUSTOMER_SAMPLES, "counted AS (SELECT s.*, coalesce(n, 0) AS n_rows FROM customer_samples s LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = ord)")
    + """SELECT CASE WHEN n_rows <= 10 THEN 'short_' ELSE 'long_' END || CASE WHEN ord % 8 IN (0, 3, 7) THEN 'lookup' ELSE 'compositional' END AS subset, count(*) AS n
FROM counted WHERE ord % 8 <> 1 GROUP BY ALL""",
)
def catalog_subsets(spark, sf_dir):
    """All four length and shape subsets of a question set in one pass."""
    from tableviews.plans import subsets

    questions = customer_samples(spark, sf_dir).withColumn("db", F.col("sample_id"))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("db")).agg(F.count("*").alias("n_rows"))
    made = subsets.catalog_subsets(questions, counts.withColumn("table_name", F.lit("orders")), short_max=10, long_min=11)
    return made.groupBy("subset").agg(F.count("*").alias("n"))


_JUDGED = f"SELECT doc_id, {filled(_W.JUDGE, truth='lang', prediction='source')} AS prompt FROM documents"


@query(
    "request_ledger",
    f"""WITH judged AS ({_JUDGED}), first AS (SELECT DISTINCT prompt FROM judged WHERE doc_id % 2 = 0 AND doc_id % 7 < 3)
SELECT doc_id, length(prompt) || ' characters' AS text, CASE WHEN first.prompt IS NULL THEN 'two' ELSE 'one' END AS wave,
 CASE WHEN first.prompt IS NULL THEN (SELECT count(DISTINCT prompt) FROM judged) - (SELECT count(*) FROM first) ELSE (SELECT count(*) FROM first) END AS n_sent
FROM judged LEFT JOIN first USING (prompt)""",
)
def request_ledger(spark, sf_dir):
    """Judge requests of all documents in two waves over one ledger: equal prompts are sent once, and the second wave sends the rest."""
    docs = table(spark, sf_dir, "documents")
    requests = exchange.make_requests(docs, "judge", ["doc_id"], prompts.judge_prompt(F.col("source"), F.col("lang")))
    folder = f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}"
    measure = lambda given: [f"{len(p)} characters" for p in given]
    one = ledger.send(requests.filter("doc_id % 2 = 0 AND doc_id % 7 < 3"), folder, measure, "one", batch_prompts=8)
    two = ledger.send(requests, folder, measure, "two", batch_prompts=8)
    n_sent = F.when(F.col("wave") == "one", one.sent).otherwise(two.sent).cast("bigint")
    return requests.select("request_id", "doc_id").join(ledger.answered(requests, folder), "request_id").select("doc_id", "text", "wave", n_sent.alias("n_sent"))


@query(
    "paired_run",
    """SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CAST(least(n, 2) AS VARCHAR) AS told, CAST(n AS VARCHAR) AS told_raw, CASE WHEN n <= 2 THEN 1 ELSE 0 END AS em, 1 AS em_raw
FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)""",
)
def paired_run(spark, sf_dir):
    """How many orders a customer has, asked on a table of the first two and on the whole one, in one run."""
    tables, rows = customer_tables(spark, sf_dir), customer_rows(spark, sf_dir)
    samples = customer_samples(spark, sf_dir).join(tables.select("sample_id", "n_rows"), "sample_id")
    samples = samples.withColumn("answer", F.parse_json(F.concat(F.lit('[["'), F.col("n_rows").cast("string"), F.lit('"]]'))))
    few = rows.filter("row_pos < 2").withColumn("n_rows", F.least("n_rows", F.lit(2).cast("bigint")))
    fewer = tables.withColumn("n_rows", F.least("n_rows", F.lit(2).cast("bigint")))
    # two lines of a table are its head
    count = lambda given: [f'{{"Answer": "{sum(line.startswith("| ") for line in p.split(chr(10))) - 2}"}}' for p in given]
    folder = f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}"
    run = evaluation.paired_run(samples, fewer, few, _segments(spark, sf_dir).limit(0), tables, rows, count, folder)
    raw = run.raw_results.select("sample_id", F.col("prediction").alias("told_raw"), F.col("em").alias("em_raw"))
    return run.results.select("sample_id", F.col("prediction").alias("told"), "em").join(raw, "sample_id")


@query(
    "repaired_sql",
    """SELECT CAST(c_custkey AS VARCHAR) AS sample_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS round,
 CASE WHEN c_custkey % 9 = 0 THEN 'SELECT o_total FROM orders;' ELSE 'SELECT o_totalprice FROM orders;' END AS statement,
 CASE WHEN c_custkey % 9 = 0 THEN 'no column o_total' END AS error FROM customer""",
)
def repaired_sql(spark, sf_dir):
    """Statements of all customers in two rounds: what names an unknown column goes back with its error."""
    def reply(given):
        import json
        import re

        out = []
        for prompt in given:
            messages = json.loads(prompt)
            number = int(re.search(r"Customer#0*(\d+)", messages[1]["content"]).group(1))
            wrong = number % (3 if len(messages) == 2 else 9) == 0
            out.append("SELECT o_total FROM orders" if wrong else "SELECT o_totalprice FROM orders")
        return out

    def unknown_columns(statements):
        named = F.regexp_extract("statement", r"SELECT (\w+)", 1)
        return statements.filter(~named.isin(ORDER_COLUMNS)).select("sample_id", F.concat(F.lit("no column "), named).alias("error"))

    folder = f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}"
    told = evaluation.sql_rounds(customer_samples(spark, sf_dir), _previews(spark, sf_dir), reply, folder, "2025-01-31", find_errors=unknown_columns)
    return told.select("sample_id", "round", "statement", "error")
