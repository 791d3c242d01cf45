"""Reading answers out of replies, and scoring them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableviews.functions.binding import with_computed
from tableviews.functions import cells as cell_functions
from tableviews.functions import replies
from tableviews.operators import exchange, scoring
from workloads.derive import spread_table, table
from workloads.registry import query

# Replies of seven shapes; numbers, lists, nothing to read.
_REPLY = """CASE o_orderkey % 7
 WHEN 0 THEN concat('```json', chr(10), '{"Answer": "', o_orderpriority, '"}', chr(10), '```')
 WHEN 1 THEN concat('  {"answer": ', CAST(o_orderkey AS STRING), '} ')
 WHEN 2 THEN concat('{"Answer": ["', o_orderstatus, '", ', CAST(o_orderkey AS STRING), ']}')
 WHEN 3 THEN concat('The answer is ', o_orderstatus, ' ')
 WHEN 4 THEN concat('{"Result": "', o_orderstatus, '"}')
 WHEN 5 THEN concat('```json {"Answer": "', o_orderstatus)
 ELSE '{"Answer": null}' END"""


def _replies(spark, sf_dir):
    return spread_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.expr(_REPLY).alias("text"), "*")


_EXTRACTED = """extracted AS (SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CASE o_orderkey % 7
 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN lower(concat('["', o_orderstatus, '",', o_orderkey, ']'))
 WHEN 3 THEN concat('The answer is ', o_orderstatus) WHEN 4 THEN concat('{"Result": "', o_orderstatus, '"}')
 WHEN 5 THEN concat('```json {"Answer": "', o_orderstatus) ELSE 'none' END AS prediction,
 CASE WHEN o_orderkey % 7 IN (3, 4, 5) THEN 'extract_failed' END AS error, * FROM orders)"""


@query("extract_answers", f"WITH {_EXTRACTED} SELECT sample_id, prediction, error FROM extracted")
def extract_answers(spark, sf_dir):
    read = with_computed(_replies(spark, sf_dir), "a", replies.extract_answer(F.col("text")))
    return read.select("sample_id", "a.prediction", "a.error")


# Ground truth as JSON: text, number, nested list with a gap, object.
_TRUTH = """CASE o_orderkey % 5
 WHEN 0 THEN concat('"', o_orderpriority, '"')
 WHEN 1 THEN CAST(o_orderkey AS STRING)
 WHEN 2 THEN concat('[["', o_orderstatus, '", ', CAST(o_orderkey AS STRING), '], [2.0, null, true]]')
 WHEN 3 THEN concat('{"b": ["x:y", 1], "a": "', o_orderstatus, '"}')
 ELSE '[]' END"""


@query(
    "normalize_answers",
    """SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CASE o_orderkey % 5 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN CAST(o_orderkey AS VARCHAR)
 WHEN 2 THEN lower(concat(o_orderstatus, ' ', o_orderkey, ' 2.0 none true')) WHEN 3 THEN lower(concat('{"a": "', o_orderstatus, '", "b": ["x:y", 1]}')) ELSE '' END AS truth,
 CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN CAST(o_orderkey AS VARCHAR) WHEN 2 THEN concat(o_orderstatus, ', ', o_orderkey, ', 2.0, None, True')
 WHEN 3 THEN concat('{"a":"', o_orderstatus, '","b":["x:y",1]}') ELSE '' END AS judged FROM orders""",
)
def normalize_answers(spark, sf_dir):
    truth = spread_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.parse_json(F.expr(_TRUTH)).alias("v"))
    return truth.select("sample_id", replies.normalize_answer(F.col("v")).alias("truth"), replies.judge_text(F.col("v")).alias("judged"))


@query(
    "ground_truth_gate",
    "SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderkey % 6 NOT IN (0, 1, 2, 3, 4) AS truthy, o_orderkey % 6 <> 0 AS present FROM orders",
)
def ground_truth_gate(spark, sf_dir):
    """A run skips missing truths, the judge also zero, empty text, empty lists and false."""
    text = """CASE o_orderkey % 6 WHEN 1 THEN '0' WHEN 2 THEN '""' WHEN 3 THEN '[]' WHEN 4 THEN 'false' WHEN 5 THEN concat('["', o_orderstatus, '"]') END"""
    truth = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.parse_json(F.expr(text)).alias("v"))
    return truth.select("sample_id", (~cell_functions.is_falsy(F.col("v"))).alias("truthy"), F.col("v").isNotNull().alias("present"))


# Predictions against the priority: equal, upper case, prefix, wrong, empty.
_PRED = """CASE o_orderkey % 5 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN lower(upper(o_orderpriority)) WHEN 2 THEN lower(substr(o_orderpriority, 1, 3))
 WHEN 3 THEN 'elsewhere' ELSE '' END"""
_ERROR = "CASE WHEN o_orderkey % 11 = 0 THEN 'extract_failed' END"
_SCORED = f"""scored AS (
 SELECT *, CASE WHEN e IS NULL AND p = g THEN 1 ELSE 0 END AS em, CASE WHEN e IS NULL AND (contains(p, g) OR contains(g, p)) THEN 1 ELSE 0 END AS pm FROM (
 SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS subset, o_orderkey, {_PRED} AS p, lower(o_orderpriority) AS g, {_ERROR} AS e FROM orders))"""


def _results(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("subset"), "o_orderkey",
        F.expr(_PRED).alias("prediction_norm"), F.lower("o_orderpriority").alias("truth_norm"), F.expr(_ERROR).alias("error"),
    )


@query("em_pm", f"WITH {_SCORED} SELECT sample_id, em, pm, CASE WHEN p <> '' THEN pm ELSE 0 END AS pm_strict FROM scored")
def em_pm(spark, sf_dir):
    return scoring.score(_results(spark, sf_dir)).select("sample_id", "em", "pm", "pm_strict")


@query(
    "score_totals",
    f"WITH {_SCORED} SELECT subset, count(*) AS n, sum(em) AS em, sum(pm) AS pm, avg(em) AS em_rate, avg(pm) AS pm_rate FROM scored GROUP BY subset",
)
def score_totals(spark, sf_dir):
    return scoring.score_totals(scoring.score(_results(spark, sf_dir)), "subset")


@query(
    "run_delta",
    f"""WITH {_SCORED}, b AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE em END AS em_b, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE pm END AS pm_b FROM scored)
SELECT subset, count(*) AS n, avg(em) AS em_rate_a, avg(em_b) AS em_rate_b, avg(em) - avg(em_b) AS em_delta, avg(pm) - avg(pm_b) AS pm_delta FROM b GROUP BY subset""",
)
def run_delta(spark, sf_dir):
    """A run on mixed input against one on tables only."""
    a = scoring.score(_results(spark, sf_dir))
    lucky = F.col("o_orderkey") % 4 == 0
    b = a.withColumns({"em": F.when(lucky, 1).otherwise(F.col("em")), "pm": F.when(lucky, 1).otherwise(F.col("pm"))})
    return scoring.run_delta(a, b, "subset")


@query(
    "judge_accuracy",
    """SELECT d.lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_correct, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS accuracy
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.lang""",
)
def judge_accuracy(spark, sf_dir):
    """Verdicts in any case and with blanks around them."""
    reply = F.when(F.col("quality") == 1, " correct\n").when(F.col("toxic") == 1, "ERROR: no_reply").otherwise("Incorrect")
    verdicts = table(spark, sf_dir, "labels").withColumn("text", reply)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return scoring.judge_accuracy(scoring.judged(verdicts.join(docs, "doc_id")), "lang")


@query(
    "outcome_counts",
    f"WITH {_SCORED} SELECT count(*) FILTER (e IS NULL) AS n_ok, count(*) FILTER (e IS NOT NULL) AS n_failed FROM scored",
)
def outcome_counts(spark, sf_dir):
    return scoring.outcome_counts(_results(spark, sf_dir))


@query(
    "replies_joined",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('reply ', o_orderstatus) END AS text,
 CASE WHEN o_orderkey % 3 <> 0 THEN 'no_reply' END AS error FROM orders""",
)
def replies_joined(spark, sf_dir):
    """Requests without a reply, or with a blank one, become errors."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.lit("question").alias("q"))
    requests = exchange.make_requests(asked, "answer", ["o_orderkey"], F.concat("q", F.lit(" "), "o_orderstatus"))
    answered = asked.filter(F.col("o_orderkey") % 3 != 1).select(
        exchange.request_id("answer", "o_orderkey").alias("request_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("reply "), "o_orderstatus")).otherwise("  ").alias("text"),
    )
    return exchange.attach_replies(requests, answered).select("o_orderkey", "text", "error")


@query(
    "reply_function",
    '''SELECT md5('["answer","' || CAST(c_custkey AS VARCHAR) || '"]') AS request_id, upper(c_name) AS text FROM customer''',
)
def reply_function(spark, sf_dir):
    """Requests answered by a user function over batches."""
    asked = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    requests = exchange.make_requests(asked, "answer", ["c_custkey"], F.col("c_name"))
    return exchange.complete_with(requests, lambda prompts: [p.upper() for p in prompts])


_IDS = """CASE o_orderkey % 4 WHEN 0 THEN concat('{"id_": "', CAST(o_orderkey AS STRING), '", "id": "other", "gt": 5}')
 WHEN 1 THEN concat('{"id_": "", "ID": "', CAST(o_orderkey AS STRING), '", "answer": ["a"]}')
 WHEN 2 THEN concat('{"qid": ', CAST(o_orderkey AS STRING), ', "gold": "g", "label": "l"}')
 ELSE '{"ground_truth": null, "answer": "x"}' END"""


@query(
    "field_fallbacks",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN concat('row', o_orderkey) ELSE CAST(o_orderkey AS VARCHAR) END AS sample_id,
 CASE o_orderkey % 4 WHEN 0 THEN '5' WHEN 1 THEN '["a"]' WHEN 2 THEN '"g"' ELSE 'null' END AS truth FROM orders""",
)
def field_fallbacks(spark, sf_dir):
    from tableviews.operators import reshape

    records = spread_table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("row"), F.col("o_orderkey").cast("string")).alias("ord"), F.parse_json(F.expr(_IDS)).alias("record")
    )
    return records.select("o_orderkey", reshape.record_id().alias("sample_id"), F.to_json(reshape.record_truth()).alias("truth"))
