"""SQL shapes, replies, templates: one text in, one value out."""

import pytest
from pyspark.sql import functions as F

from tableviews.functions import cells, markdown, replies, sqltext, text


@pytest.fixture
def on(spark):
    """Value of a column expression over one text."""
    def run(value, make):
        df = spark.createDataFrame([(value,)], "x string")
        return df.select(make(F.col("x")).alias("y")).collect()[0].y

    return run


TAGGED = [
    ("SELECT a FROM t WHERE b = 'x'", ["SimpleProjection"]),
    ("SELECT a FROM t WHERE b = 'x';", []),
    ("SELECT a FROM t", ["SimpleProjection"]),
    ("SELECT DISTINCT t.a, `b c` FROM t WHERE t.d LIKE 'x%' AND e IN ('p', 'q')", ["SimpleProjection"]),
    ("SELECT a FROM t WHERE b BETWEEN 'a' AND 'c'", ["SimpleProjection"]),
    ("SELECT a FROM t WHERE year = 2021", ["Comparison"]),
    ("SELECT a FROM t WHERE b BETWEEN 1 AND 3", ["Comparison"]),
    ("SELECT a FROM t WHERE 5 < b", ["Comparison"]),
    ("SELECT a FROM t WHERE b = 'x' OR c = 'y'", []),
    ("SELECT a FROM t WHERE b IN (SELECT c FROM u)", []),
    ("SELECT MIN(a) FROM t", ["Max/Min"]),
    ("SELECT a FROM t LIMIT 1", ["Max/Min"]),
    ("SELECT a FROM t LIMIT 10", ["SimpleProjection"]),
    ("SELECT COUNT(*) FROM t", ["Aggregation"]),
    ("SELECT a FROM t ORDER BY b DESC LIMIT 1", ["Max/Min", "Ranking"]),
    ("SELECT a FROM t JOIN u ON t.k = u.k AND u.n = 3", ["Join"]),
    ("SELECT a FROM t JOIN u ON t.k = 3 WHERE t.n > 2", ["Join", "Comparison"]),
    ("SELECT a FROM t WHERE b = 'max of 3 = 3'", ["SimpleProjection"]),
    ("SELECT a FROM t WHERE b = 'the sum'", []),
    ("SELECT SUM(x) FROM t GROUP BY y HAVING SUM(x) > 3 ORDER BY 1", ["Aggregation", "Ranking", "Comparison"]),
]


@pytest.mark.parametrize("sql,tags", TAGGED)
def test_tags(on, sql, tags):
    assert on(sql, sqltext.sql_tags) == tags


def test_tables_of_sql(on):
    assert on("select * from a JOIN `b` on x join A, c from \"d e\"", sqltext.sql_tables) == ["a", "b", "A", "d"]
    assert on("WITH x AS (SELECT 1 FROM y) SELECT 2 FROM x", sqltext.sql_tables) == ["y", "x"]


def test_predicates(on):
    where = "t.a = 'x' AND b BETWEEN 1 AND 2.5 AND `c d` IN ('p', \"q\") AND e LIKE '%z'"
    got = on(where, sqltext.predicates)
    assert [(p.col, p.op, p.args) for p in got] == [
        ("a", "=", ["x"]), ("b", "between", ["1", "2.5"]), ("c d", "in", ["p", "q"]), ("e", "like", ["%z"]),
    ]
    assert on("a = 'x' OR b = 'y'", sqltext.predicates) is None
    assert on("", sqltext.predicates) == []


def test_aggregate_spec(on):
    s = on("SELECT g, AVG(x) FROM t WHERE k = 'v' GROUP BY g ORDER BY AVG(x) DESC LIMIT 3;", sqltext.aggregate_spec)
    assert (s.func, s.target, s.group_col, s.shows, s.order_by, s.descending, s.row_limit) == ("avg", "x", "g", "both", "value", True, 3)
    assert s.preds[0].col == "k"
    assert on("SELECT COUNT(*) FROM t", sqltext.aggregate_spec).shows == "value"
    for other in ("SELECT a FROM t", "SELECT SUM(x), MAX(y) FROM t", "SELECT SUM(x) FROM t JOIN u ON t.a = u.a", "SELECT SUM(x) FROM t WHERE a > 3"):
        assert on(other, sqltext.aggregate_spec) is None


def test_fill_prompt_does_not_scan_values(on):
    fill = lambda t: text.fill_prompt(t, {"db": F.lit("{table} {{x}}"), "table": F.lit("T")})
    assert on("{db}/{table} {{keep}} {other}", fill) == "{table} {{x}}/T {keep} {other}"


def test_fill_template(on):
    names = F.array(F.lit("a"), F.lit("b"))
    fill = lambda how: lambda t: text.fill_template(t, names, F.array(F.lit("<{b}>"), F.lit(None)), how)
    assert on("{a} and {b}", fill("keep")) == "<{b}> and {b}"
    assert on("{a} and {b}", fill("mark")) == "<[b=NA]> and [b=NA]"


def test_column_lines_and_examples(on):
    examples = F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit("2")), F.lit("b"), F.array().cast("array<string>"))
    assert on("", lambda _: text.column_lines(F.array(F.lit("a"), F.lit("b"), F.lit("c")), examples)) == "a (1, 2)\nb\nc"
    assert on("", lambda _: text.example_block(F.array(F.lit("a")), examples)) == "[SELECTED] a: 1, 2"


LABELS = [
    ('x ```json {"column_classification": {"a": "YES"}, "combinations": [["a", 2, 1.5], 3]} ``` y', {"a": "YES"}, [["a", "2"]], False),
    ('[{"column_classification": {"a": "no"}}]', {"a": "no"}, [], False),
    ('{"column_classification": ["a"], "combinations": {}}', {}, [], True),
    ("{broken", {}, [], True),
    ("[]", {}, [], True),
    ('```JSON\n{"column_classification": {"a": "YES"}}\n```', {}, [], True),
]


@pytest.mark.parametrize("reply,labels,combinations,failed", LABELS)
def test_label_replies(on, reply, labels, combinations, failed):
    got = on(reply, replies.parse_label_reply)
    assert (got.labels, got.combinations, got.failed) == (labels, combinations, failed)


ANSWERS = [
    ('{"Answer": " North "}', "north", None),
    ('```json\n{"answer": 5.0}\n```', "5.0", None),
    ('{"Answer": true}', "true", None),
    ('{"Answer": null, "answer": "x"}', "none", None),
    ('{"Other": 1}', '{"Other": 1}', "extract_failed"),
    ('```json\n{"Other": 1}\n```', '{"Other": 1}', "extract_failed"),
    ("```json\n{broken", "```json\n{broken", "extract_failed"),
    ("", "", "extract_failed"),
]


@pytest.mark.parametrize("reply,prediction,error", ANSWERS)
def test_extract_answer(on, reply, prediction, error):
    got = on(reply, replies.extract_answer)
    assert (got.prediction, got.error) == (prediction, error)


NORMAL = [
    ('[["A", [1, [2.5, null]]], true]', "a 1 2.5 none true", "A, 1, 2.5, None, True"),
    ('{"b": 1, "a": ["X, y", {"c": null}]}', '{"a": ["x, y", {"c": null}], "b": 1}', None),
    ('" Word "', " word ", "Word"),
    ("[]", "", ""),
    ("7", "7", "7"),
]


@pytest.mark.parametrize("value,normal,judged", NORMAL)
def test_normalize(on, value, normal, judged):
    assert on(value, lambda x: replies.normalize_answer(F.parse_json(x))) == normal
    if judged is not None:
        assert on(value, lambda x: replies.judge_text(F.parse_json(x))) == judged


def test_matches(spark):
    cases = [("a", "a", None, 1, 1, 1), ("ab", "a", None, 0, 1, 1), ("", "a", None, 0, 1, 0), ("a", "a", "lost", 0, 0, 0), ("b", "a", None, 0, 0, 0)]
    df = spark.createDataFrame([c[:3] for c in cases], "p string, g string, e string")
    got = df.select(
        replies.exact_match(F.col("p"), F.col("g"), F.col("e")), replies.partial_match(F.col("p"), F.col("g"), F.col("e")),
        replies.partial_match(F.col("p"), F.col("g"), F.col("e"), strict=True),
    ).collect()
    assert [tuple(r) for r in got] == [c[3:] for c in cases]


@pytest.mark.parametrize(
    "value,expected",
    [(None, True), ("0", True), ("0.0", True), ('""', True), ("[]", True), ("{}", True), ("false", True), ("null", True), ("[0]", False), ('"0"', False)],
)
def test_falsy(on, value, expected):
    assert on(value, lambda x: cells.is_falsy(F.parse_json(x))) is expected


def test_meaningful(spark):
    cases = [([], False), (["0"], False), (["0", "1"], True), ([None], False), ([""], False), (["NaN"], False), (["Nan"], True), (["x", None], True), (["0.0"], False)]
    df = spark.createDataFrame([(c[0],) for c in cases], "a array<string>")
    assert [r[0] for r in df.select(cells.is_meaningful(F.col("a"))).collect()] == [c[1] for c in cases]


def test_type_vote(spark):
    cases = [
        (["BIGINT", "DOUBLE"], ["1", "2.0"], "REAL"), (["BOOLEAN"], ["True"], "INTEGER"), (["STRING", "STRING"], ["1", "1.5"], "REAL"),
        (["STRING"], [" 7 "], "INTEGER"), (["STRING", "BIGINT"], ["x", "1"], "INTEGER"), (["STRING"], ["1d"], "TEXT"), (["STRING"], ["1e3"], "REAL"),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "k array<string>, t array<string>")
    long = df.withColumn("i", F.monotonically_increasing_id()).select("i", F.explode(F.arrays_zip("k", "t")).alias("z"))
    voted = long.groupBy("i").agg(cells.voted_sql_type(F.col("z.k"), F.col("z.t")).alias("v")).orderBy("i")
    assert [r.v for r in voted.collect()] == [c[2] for c in cases]


def test_nested_answers_are_flat_or_fail(on):
    deep = "[" * 9 + "1, 2" + "]" * 9
    assert on(deep, lambda x: F.transform(cells.flat_values(F.parse_json(x)), lambda v: v.cast("string"))) == ["1", "2"]
    with pytest.raises(Exception, match="nested deeper"):
        on("[" * 15 + "1" + "]" * 15, lambda x: F.transform(cells.flat_values(F.parse_json(x)), lambda v: v.cast("string")))


@pytest.mark.parametrize(
    "md,columns,rows",
    [
        ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\n|| 4 |\n5 | 6", ["a", "b"], [["1", "2"], ["5", "6"]]),
        ("| a |", [], []),
        ("", [], []),
        ("a | b\n---", ["a", "b"], []),
    ],
)
def test_markdown_tables(on, md, columns, rows):
    got = on(md, markdown.parse_table)
    assert (got.columns, got.rows) == (columns, rows)


def test_sql_guard_and_notes(on):
    assert on("x ```sql\n(SELECT 1;\n``` y", replies.guard_sql).sql == "(SELECT 1;"
    assert on("with a as (select 1) select 2", replies.guard_sql).error == "Only SELECT is allowed."
    assert on("SELECT 1 <!--Note--> guess\n2 ", replies.sql_note) == "guess\n2"
    assert on("SELECT 1 <!--note--> guess", replies.sql_without_note) == "SELECT 1"
    assert on("SELECT 1", replies.sql_note) is None


def test_list_fields(on):
    assert on(' ["a ", 3, " "] ', replies.parse_list_field) == ["a", "3"]
    assert on("a, ,b", replies.parse_list_field) == ["a", "b"]
    assert on("[a, b", replies.parse_list_field) == ["[a", "b"]
    assert on(None, replies.parse_list_field) == []
