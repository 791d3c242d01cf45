"""Template sets, row sentences, exact shares of rows, paragraphs, answer gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableviews.functions import cells as cell_functions
from tableviews.operators import templates, verbalize
from tableviews.plans import representation
from workloads.derive import (
    LINE_ROWS, ORDER_SAMPLES, duck_hash, joined, order_rows, order_samples, order_tables, table,
    with_ctes,
)
from workloads.registry import query

# Three template sets per priority; the last one names a column that no table has.
FLAG_TEMPLATES = ["{l_quantity} pieces carry flag {l_returnflag}.", "Flag {l_returnflag} stands on {l_quantity} pieces."]
PRICE_TEMPLATES = [
    "Line {l_linenumber} costs {l_extendedprice} and left on {l_shipdate}.",
    "On {l_shipdate} line {l_linenumber} left for {l_extendedprice}.",
    "For {l_extendedprice}, line {l_linenumber} was shipped on {l_shipdate}.",
]
SETS = [
    (0, ["l_quantity", "l_returnflag", ""], [FLAG_TEMPLATES[0], "ERROR", FLAG_TEMPLATES[1], "", ""]),
    (1, ["l_linenumber", "l_extendedprice", "l_shipdate"], [*PRICE_TEMPLATES, "Only {l_shipdate}.", ""]),
    (2, ["l_colour", "", ""], ["It is {l_colour}.", "", "", "", ""]),
]


def wide_sets(spark, sf_dir):
    """Template table in its wide form, for every priority but one."""
    priorities = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("db")).distinct().filter("db NOT LIKE '3%'")
    rows = F.array(*[F.struct(F.lit(n).alias("set_no"), F.array(*map(F.lit, cs)).alias("c"), F.array(*map(F.lit, ts)).alias("t")) for n, cs, ts in SETS])
    sets = priorities.select("db", F.lit("lineitem").alias("table_name"), F.explode(rows).alias("s"))
    return sets.select(
        "db", "table_name", "s.set_no",
        *[F.get("s.c", F.lit(i)).alias(f"column{i + 1}") for i in range(3)],
        *[F.get("s.t", F.lit(i)).alias(f"template{i + 1}") for i in range(5)],
    )


_CHOSEN = f"""chosen AS (
 SELECT sample_id, ord, db, CASE WHEN db NOT LIKE '3%' THEN {duck_hash(42, 'sample_id', '0')} % 2 END AS set_no FROM order_samples)"""
_COMPLETE = f"""complete AS (
 SELECT r.*, c.db, c.set_no, {duck_hash(42, 'r.sample_id', '0', 'row_pos')} AS h FROM line_rows r JOIN chosen c ON c.sample_id = r.sample_id
 WHERE c.set_no = 1 OR (c.set_no = 0 AND l_partkey % 4 <> 0))"""
_DATE = "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"


def _duck_fill(template: str) -> str:
    text = "'" + template + "'"
    for c in ("l_quantity", "l_returnflag", "l_linenumber", "l_extendedprice"):
        text = f"replace({text}, '{{{c}}}', CAST({c} AS VARCHAR))"
    return f"replace({text}, '{{l_shipdate}}', {_DATE})"


_DESCRIBED = (
    "described AS (SELECT *, CASE set_no WHEN 0 THEN CASE h % 2 "
    + " ".join(f"WHEN {i} THEN {_duck_fill(t)}" for i, t in enumerate(FLAG_TEMPLATES))
    + " END ELSE CASE h % 3 "
    + " ".join(f"WHEN {i} THEN {_duck_fill(t)}" for i, t in enumerate(PRICE_TEMPLATES))
    + " END END AS description FROM complete)"
)
_SPLIT = """split AS (
 SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY sample_id ORDER BY h, row_pos) AS rk FROM described WINDOW w AS (PARTITION BY sample_id)), marked AS (
 SELECT *, floor(n * 0.5) >= 1 AND floor(n * 0.5) < n AND rk <= floor(n * 0.5) AS taken FROM split)"""
_ALL = with_ctes(ORDER_SAMPLES, LINE_ROWS, _CHOSEN, _COMPLETE, _DESCRIBED, _SPLIT)


def _chosen(spark, sf_dir):
    return verbalize.choose_template_sets(order_tables(spark, sf_dir), templates.template_sets(wide_sets(spark, sf_dir)))


def _split(spark, sf_dir):
    # types of cells are not told, so they do not travel
    return verbalize.split_rows(order_rows(spark, sf_dir, nulls=True).drop("vtypes"), _chosen(spark, sf_dir))


@query(
    "template_sets",
    "SELECT DISTINCT o_orderpriority AS db, set_no, columns, n_templates FROM orders CROSS JOIN (VALUES (0, 'l_quantity, l_returnflag', 2), "
    "(1, 'l_linenumber, l_extendedprice, l_shipdate', 3), (2, 'l_colour', 1)) AS t(set_no, columns, n_templates) WHERE o_orderpriority NOT LIKE '3%'",
)
def template_sets(spark, sf_dir):
    sets = templates.template_sets(wide_sets(spark, sf_dir))
    return sets.select("db", "set_no", joined("columns").alias("columns"), F.size("templates").alias("n_templates"))


@query("pick_template", with_ctes(ORDER_SAMPLES, _CHOSEN) + "SELECT sample_id, CAST(set_no AS INTEGER) AS set_no FROM chosen")
def pick_template(spark, sf_dir):
    return _chosen(spark, sf_dir).select("sample_id", "set_no")


@query("drop_null_rows", _ALL + "SELECT sample_id, CAST(row_pos AS BIGINT) AS row_pos, l_quantity AS quantity FROM complete")
def drop_null_rows(spark, sf_dir):
    """The raw version: rows that have a value in every column of the set."""
    complete = verbalize.complete_rows(order_rows(spark, sf_dir, nulls=True), _chosen(spark, sf_dir))
    return complete.select("sample_id", "row_pos", F.get("cells", F.lit(3)).cast("double").alias("quantity"))


@query(
    "verbalize_rows",
    _ALL
    + f"""SELECT sample_id, CAST(row_pos AS BIGINT) AS row_pos, description, CASE set_no
 WHEN 0 THEN concat_ws(',', l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_linestatus, {_DATE})
 ELSE concat_ws(',', l_partkey, l_suppkey, l_quantity, l_discount, l_tax, CASE WHEN l_partkey % 4 <> 0 THEN l_returnflag END, l_linestatus) END AS rest FROM described""",
)
def verbalize_rows(spark, sf_dir):
    """Every complete row with its sentence and the cells that stay."""
    described = verbalize.describe_rows(order_rows(spark, sf_dir, nulls=True), _chosen(spark, sf_dir))
    return described.select("sample_id", "row_pos", "description", F.array_join("cells", ",").alias("rest"))


@query(
    "described_headers",
    with_ctes(ORDER_SAMPLES, _CHOSEN)
    + """SELECT sample_id, CASE set_no WHEN 0 THEN 'l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_discount,l_tax,l_linestatus,l_shipdate,_description'
 WHEN 1 THEN 'l_partkey,l_suppkey,l_quantity,l_discount,l_tax,l_returnflag,l_linestatus,_description'
 ELSE 'l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate' END AS columns FROM chosen""",
)
def described_headers(spark, sf_dir):
    return verbalize.described_headers(_chosen(spark, sf_dir)).select("sample_id", joined("columns", ",").alias("columns"))


@query(
    "ratio_split",
    _ALL + "SELECT sample_id, CAST(row_pos AS BIGINT) AS row_pos, taken, CASE WHEN taken THEN description END AS description FROM marked",
)
def ratio_split(spark, sf_dir):
    """Exactly half of the complete rows of every table, rounded down, become text."""
    return _split(spark, sf_dir).select("sample_id", "row_pos", "taken", "description")


_PARAGRAPHS = "paragraphs AS (SELECT sample_id, string_agg(description, ' ' ORDER BY row_pos) AS body FROM marked WHERE taken GROUP BY sample_id)"


@query("paragraphs", _ALL.rstrip() + ",\n" + _PARAGRAPHS + " SELECT sample_id, CAST(0 AS BIGINT) AS part, body FROM paragraphs")
def paragraphs(spark, sf_dir):
    return verbalize.paragraphs(_split(spark, sf_dir)).select("sample_id", "part", "body")


@query("text_segments", _ALL.rstrip() + ",\n" + _PARAGRAPHS + " SELECT sample_id, 1 AS n_segments, trim(body) AS first_text FROM paragraphs")
def text_segments(spark, sf_dir):
    nested = verbalize.nested_segments(verbalize.paragraphs(_split(spark, sf_dir)))
    return nested.select("sample_id", F.size("verbalized_data").alias("n_segments"), F.get("verbalized_data", F.lit(0))["text"].alias("first_text"))


@query("samples_with_text", _ALL.rstrip() + ",\n" + _PARAGRAPHS + " SELECT sample_id, db FROM order_samples WHERE sample_id IN (SELECT sample_id FROM paragraphs)")
def samples_with_text(spark, sf_dir):
    parts = verbalize.paragraphs(_split(spark, sf_dir))
    return verbalize.samples_with_text(order_samples(spark, sf_dir), parts).select("sample_id", "db")


@query(
    "used_columns",
    with_ctes(ORDER_SAMPLES, _CHOSEN)
    + """SELECT sample_id, CASE set_no WHEN 0 THEN 'lineitem: l_quantity,l_returnflag' ELSE 'lineitem: l_extendedprice,l_linenumber,l_shipdate' END AS used
FROM chosen WHERE set_no IS NOT NULL""",
)
def used_columns(spark, sf_dir):
    used = verbalize.used_columns(_chosen(spark, sf_dir))
    told = F.transform(F.map_entries("used_keys"), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], ",")))
    return used.select("sample_id", F.array_join(told, "; ").alias("used"))


@query(
    "verbalization_status",
    _ALL
    + """SELECT status, count(*) AS count FROM (SELECT c.sample_id, CASE WHEN c.set_no IS NULL THEN 'no_template' WHEN m.n IS NULL THEN 'all_null'
 WHEN m.told = 0 THEN 'ratio_takes_none' ELSE 'verbalized' END AS status FROM chosen c LEFT JOIN
 (SELECT sample_id, count(*) AS n, count(*) FILTER (taken) AS told FROM marked GROUP BY sample_id) m ON m.sample_id = c.sample_id) GROUP BY status""",
)
def verbalization_status(spark, sf_dir):
    return verbalize.status_counts(verbalize.table_status(_chosen(spark, sf_dir), _split(spark, sf_dir)))


# Answers by customer number: empty, with a gap, with a NaN, a lone zero, a lone empty text, two values.
_FLAT = """CASE CAST(c_custkey % 6 AS INT) WHEN 1 THEN array(c_name, NULL) WHEN 2 THEN array('NaN') WHEN 3 THEN array('0')
 WHEN 4 THEN array('') WHEN 5 THEN array(c_name, 'x') ELSE CAST(array() AS ARRAY<STRING>) END"""


@query("answer_gate", "SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_custkey % 6 IN (3, 4, 5) AS ok FROM customer")
def answer_gate(spark, sf_dir):
    flat = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.expr(_FLAT).alias("flat"))
    return verbalize.gate_by_answer(flat, "flat").select("sample_id", "ok")


@query("meaningful_answers", "SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_custkey % 6 IN (1, 5) AS meaningful FROM customer")
def meaningful_answers(spark, sf_dir):
    flat = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.expr(_FLAT).alias("flat"))
    return flat.select("sample_id", cell_functions.is_meaningful(F.col("flat")).alias("meaningful"))


@query(
    "finite_values",
    "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN value END AS value FROM events",
)
def finite_values(spark, sf_dir):
    """NaN and infinities become NULL."""
    odd = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    values = table(spark, sf_dir, "events").select("event_id", F.array(odd).alias("xs"))
    return values.select("event_id", F.get(cell_functions.finite_elements(F.col("xs")), F.lit(0)).alias("value"))


@query(
    "representation_by_column",
    _ALL + """SELECT c.sample_id, CASE WHEN c.set_no IS NULL THEN 'no_template' WHEN m.n IS NULL THEN 'all_null' ELSE 'verbalized' END AS status,
 coalesce(m.n, w.n, 0) AS n_semi_rows, coalesce(m.chars, 0) AS n_chars FROM chosen c LEFT JOIN
 (SELECT sample_id, count(*) AS n, sum(length(description)) AS chars FROM described GROUP BY sample_id) m ON m.sample_id = c.sample_id
 LEFT JOIN (SELECT sample_id, count(*) AS n FROM line_rows GROUP BY sample_id) w ON w.sample_id = c.sample_id""",
)
def representation_by_column(spark, sf_dir):
    """The whole column variant: chosen sets, described rows, and what became of each table."""
    made = representation.by_column(order_tables(spark, sf_dir), order_rows(spark, sf_dir, nulls=True), templates.template_sets(wide_sets(spark, sf_dir)))
    chars = made.rows.groupBy("sample_id", "table_pos").agg(
        F.count("*").alias("n_semi_rows"), F.sum(F.length("description")).alias("n_chars")
    )
    return made.status.select("sample_id", "table_pos", "status").join(chars, ["sample_id", "table_pos"], "left").na.fill(0).drop("table_pos")


@query(
    "representation_by_row",
    _ALL.rstrip() + ",\n" + _PARAGRAPHS + """
SELECT m.sample_id, count(*) AS n_raw_rows, count(*) FILTER (NOT taken) AS n_semi_rows, any_value(body) AS body
FROM marked m JOIN paragraphs p ON p.sample_id = m.sample_id GROUP BY m.sample_id""",
)
def representation_by_row(spark, sf_dir):
    """The whole row variant for samples that got a paragraph: raw rows, remaining rows, text."""
    made = representation.by_row(order_tables(spark, sf_dir), order_rows(spark, sf_dir, nulls=True), templates.template_sets(wide_sets(spark, sf_dir)))
    counts = made.raw_rows.groupBy("sample_id").agg(F.count("*").alias("n_raw_rows")).join(
        made.rows.groupBy("sample_id").agg(F.count("*").alias("n_semi_rows")), "sample_id"
    )
    return made.segments.select("sample_id", F.col("text").alias("body")).join(counts, "sample_id")
