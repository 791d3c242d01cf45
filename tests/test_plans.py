"""Whole steps on a small corpus."""

import pytest
from pyspark.sql import functions as F

from tableviews.operators import answers, exchange, prompts, reshape, scoring, templates, verbalize
from tableviews.plans import evaluation, profile, representation, subsets


@pytest.fixture(scope="module")
def sets(spark):
    wide = spark.createDataFrame(
        [
            ("shop", "goods", "name", "colour", "The {name} is {colour}.", "{colour} {name}", "ERROR"),
            ("shop", "goods", "weight", "", "It weighs {weight}.", "", ""),
            ("shop", "other", "name", "", " ", "", None),
        ],
        "db string, table_name string, column1 string, column2 string, template1 string, template2 string, template3 string",
    )
    return templates.template_sets(wide)


def test_template_sets(sets):
    got = sorted((r.columns, r.templates) for r in sets.collect())
    assert got == [(["name", "colour"], ["The {name} is {colour}.", "{colour} {name}"]), (["weight"], ["It weighs {weight}."])]


def test_columns_become_descriptions(corpus, sets):
    _, _, tables, rows = corpus
    made = representation.by_column(tables.drop("content", "paragraph", "header_rows"), rows, sets)
    told = {(r.sample_id, r.row_pos): r for r in made.rows.filter("description IS NOT NULL").collect()}
    assert set(told) == {("s1", 0), ("s1", 1), ("s1", 2), ("s1", 3), ("s2", 0), ("s2", 1), ("s2", 2)}
    assert all(c in told[("s1", 1)].description for c in ("lamp", "blue"))
    assert told[("s1", 1)].cells == ["12.5", None, "False"]
    header = {r.sample_id: r.columns for r in made.tables.collect()}
    assert header["s1"] == ["price", "stock", "sold", "_description"] and header["s4"] == ["left", "right"]
    status = {r.sample_id: r.status for r in made.status.collect()}
    assert status == {"s1": "verbalized", "s2": "verbalized", "2": "no_template", "s4": "no_template"}
    assert made.raw_rows.filter("sample_id = 's1'").count() == 4
    assert made.used.filter("sample_id = 's1'").collect()[0].used_keys == {"goods": ["colour", "name"]}


def test_part_of_the_rows_becomes_text(corpus, sets):
    _, _, tables, rows = corpus
    made = representation.by_row(tables.drop("content", "paragraph", "header_rows"), rows, sets, ratio=0.5)
    text = {r.sample_id: r.text for r in made.segments.collect()}
    assert set(text) == {"s1", "s2"}
    counts = lambda df: {r.sample_id: r["count"] for r in df.groupBy("sample_id").count().collect()}
    assert counts(made.raw_rows) == {"s1": 4, "s2": 3}
    assert counts(made.rows) == {"s1": 2, "s2": 2}
    assert {r.sample_id for r in made.tables.collect()} == {"s1", "s2"}


def test_choice_does_not_depend_on_partitions(corpus, sets):
    _, _, tables, rows = corpus
    a = verbalize.describe_rows(rows, verbalize.choose_template_sets(tables, sets))
    b = verbalize.describe_rows(rows.repartition(3), verbalize.choose_template_sets(tables.repartition(3), sets.repartition(2)))
    key = lambda df: sorted((r.sample_id, r.row_pos, r.description) for r in df.collect())
    assert key(a) == key(b)


def test_all_rows_incomplete(spark):
    tables = spark.createDataFrame([("x", 0, 0, "d", "t", ["a", "b"], 2, 2)], "sample_id string, ord long, table_pos int, db string, table_name string, columns array<string>, n_rows long, n_cols int")
    rows = spark.createDataFrame([("x", 0, 0, 2, [None, "1"], ["VOID", "STRING"]), ("x", 0, 1, 2, [None, "2"], ["VOID", "STRING"])], "sample_id string, table_pos int, row_pos long, n_rows long, cells array<string>, vtypes array<string>")
    sets = spark.createDataFrame([("d", "t", 0, ["a"], ["{a}."])], "db string, table_name string, set_no int, columns array<string>, templates array<string>")
    made = representation.by_column(tables, rows, sets)
    assert [r.status for r in made.status.collect()] == ["all_null"]
    assert made.rows.count() == 2 and made.tables.collect()[0].columns == ["a", "b"]
    # sets are chosen once: what is asked of them later reads the stored choice and the stored rows
    assert len({file.rsplit("/", 2)[1] for file in made.status.inputFiles()}) == 2


def test_profiles(corpus):
    _, _, tables, rows = corpus
    used = profile.usage_profile(tables, rows).filter("db = 'shop'").collect()[0]
    assert used.column_examples["colour"] == ["red", "blue", "green"]
    high = profile.high_freq_profile(tables, rows).filter("db = 'shop'").collect()[0]
    assert "colour" in high.high_freq_columns and "note, long" in high.low_freq_columns


def test_column_prompts_with_own_template(corpus):
    _, _, tables, rows = corpus
    used = profile.usage_profile(tables, rows).filter("db = 'shop'")
    got = prompts.column_requests(used, templates.columns_in_scope("query"), F.lit("{{json}} {db}.{table}:\n{cols}")).collect()
    assert got[0].prompt.startswith("{json} shop.goods:\ncolour (red, blue, green)\nname (lamp, chair)")
    assert prompts.column_requests(used, templates.columns_in_scope("all")).count() == 5


def test_question_run(spark, corpus):
    records, samples, tables, rows = corpus
    views = prompts.qa_views(samples, tables, rows, reshape.texts_of(records), views=["structured"])
    requests = evaluation.qa_requests(views)
    replies = exchange.complete_with(requests, lambda ps: ['{"Answer": "12.5"}' if "lamp" in p else "red?" for p in ps])
    got = {r.sample_id: (r.prediction, r.error, r.em, r.pm) for r in evaluation.qa_results(views, samples, replies).collect()}
    assert got["s1"] == ("12.5", None, 1, 1)
    assert got["s2"] == ("red?", "extract_failed", 0, 0)
    assert "s4" not in got and "2" not in got


def test_sql_run(spark, corpus):
    _, samples, tables, rows = corpus
    previews = prompts.schema_previews(rows, tables, reshape.cells_of(rows, tables))
    requests = evaluation.sql_requests(samples, previews, today="2025-01-31")
    replies = requests.select("request_id", F.when(F.col("sample_id") == "s1", "```sql\nSELECT 1\n```<!--note-->guess").when(F.col("sample_id") == "s2", "drop table goods").alias("text"))
    got = {r.sample_id: r for r in evaluation.sql_statements(requests, replies).collect()}
    assert (got["s1"].statement, got["s1"].note, got["s1"].error) == ("SELECT 1;", "guess", None)
    assert got["s2"].error == "Only SELECT is allowed." and got["s4"].error == "no_reply"
    failed = evaluation.sql_statements(requests, replies).filter("sample_id = 's2'").select("sample_id", "sql", "error")
    assert evaluation.repair_requests(requests, failed).count() == 1


def test_judging(corpus):
    _, samples, _, _ = corpus
    requests = evaluation.judge_requests(samples.withColumn("prediction", F.lit(" x ")))
    assert requests.count() == 2
    replies = requests.limit(1).select("request_id", F.lit(" correct ").alias("text"))
    total = scoring.judge_accuracy(evaluation.judge_results(requests, replies)).collect()[0]
    assert (total.n, total.n_correct, total.accuracy) == (2, 1, 0.5)


def test_every_view_is_judged_apart(spark):
    results = spark.createDataFrame([("s1", "structured", "x", '"x"'), ("s1", "unstructured", "y", '"x"')], "sample_id string, view string, prediction string, a string")
    requests = evaluation.judge_requests(results.withColumn("answer", F.parse_json("a")))
    assert requests.select("request_id").distinct().count() == 2
    replies = requests.select("request_id", F.when(F.col("view") == "structured", "CORRECT").otherwise("INCORRECT").alias("text"))
    blank = requests.select("request_id", F.lit(" ").alias("text"))
    verdicts = {r.view: r.judge_label for r in evaluation.judge_results(requests, replies.unionByName(blank)).collect()}
    assert verdicts["structured"] == "CORRECT" and verdicts["unstructured"] != "CORRECT"


def test_a_long_markdown_table_comes_back_whole(spark):
    n = 25_000
    tables = spark.createDataFrame([("t", 0, None, ["a", "b"])], "sample_id string, table_pos int, table_name string, columns array<string>")
    rows = spark.range(n).select(F.lit("t").alias("sample_id"), F.lit(0).alias("table_pos"), F.col("id").alias("row_pos"), F.array(F.col("id").cast("string"), F.lit("x")).alias("cells"))
    rendered = prompts.render_tables(rows, tables)
    assert rendered.count() > 1
    none = F.array().cast("array<string>")
    meta = rendered.select(F.col("sample_id").alias("table_id"), F.lit(0).alias("ord"), "part", F.lit("flat").alias("struct_type"), "markdown", none.alias("pre_context"), none.alias("post_context"))
    golden = '[{"%s": [{"%s": ["yes"]}]}]' % (subsets.ANSWER_LIST, subsets.FINAL_ANSWER)
    questions = spark.createDataFrame([("q", "t", subsets.SIMPLE_TASK, ["?"], golden)], "sample_id string, table_id string, sub_task string, questions array<string>, g string")
    got = subsets.markdown_subset(questions.withColumn("golden", F.parse_json("g")), meta, max_rows=None).first()
    assert got.n_rows == n and got.columns == ["a", "b"] and [r[0] for r in got.rows] == [str(k) for k in range(n)]


def test_multi_table_subsets(spark):
    rows = [(f"s{i}", i, "two" if i % 2 else "three", t, 5 + i) for i in range(10) for t in range(2)]
    tables = spark.createDataFrame(rows, "sample_id string, ord long, grp string, table_pos int, n_rows long")
    got = subsets.multi_table_subsets(tables, "grp", short=(1, 8), long_min=9, per_group=2)
    assert sorted((r.subset, r.sample_id) for r in got.collect()) == [
        ("long", "s4"), ("long", "s5"), ("long", "s6"), ("long", "s7"), ("short", "s0"), ("short", "s1"), ("short", "s2"), ("short", "s3"),
    ]


def test_answers_of_all_kinds_meet_their_tables_once(corpus, monkeypatch):
    _, samples, tables, rows = corpus
    met, joins = [], []
    of_tables, with_tables = answers._of_tables, answers.with_tables
    monkeypatch.setattr(answers, "_of_tables", lambda *a: met.append(1) or of_tables(*a))
    monkeypatch.setattr(answers, "with_tables", lambda *a: joins.append(1) or with_tables(*a))
    queries, headers = samples.select("sample_id", "sql"), tables.drop("content", "paragraph", "header_rows")
    again = {tuple(map(str, r)) for r in answers.recompute_answers(queries, headers, rows).collect()}
    assert (len(met), len(joins)) == (1, 1)
    lookups = answers.answer_lookups(queries, headers, rows).collect()
    aggregates = answers.answer_aggregates(queries, headers, rows).collect()
    assert again == {tuple(map(str, r)) for r in lookups} | {(r.sample_id, "0", str(r.answer)) for r in aggregates}


def test_templates_do_not_travel_with_split_rows(corpus, sets, monkeypatch):
    _, _, tables, rows = corpus
    kept, stored = [], verbalize.stored
    monkeypatch.setattr(verbalize, "stored", lambda df, *a: kept.append(df.columns) or stored(df, *a))
    chosen = verbalize.choose_template_sets(tables.drop("content", "paragraph", "header_rows"), sets)
    split = verbalize.split_rows(rows, chosen).collect()
    assert len(kept) == 1 and not {"templates", "set_columns", "set_positions"} & set(kept[0])
    assert sum(r.taken for r in split) and all((r.description is not None) == r.taken for r in split)


def test_rows_of_the_row_variant_are_stored_once(corpus, sets, monkeypatch):
    _, _, tables, rows = corpus
    kept, stored = [], representation.stored
    monkeypatch.setattr(representation, "stored", lambda df, *a: kept.append(df.columns) or stored(df, *a))
    made = representation.by_row(tables.drop("content", "paragraph", "header_rows"), rows, sets)
    assert kept == [["sample_id", "table_pos", "last_h", "last_tie"]]
    assert made.rows.columns == made.raw_rows.columns == rows.columns and made.segments.count() > 0
