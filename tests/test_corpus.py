"""Reading corpora, normalizing and nesting them."""

import json

import pytest

from pyspark.sql import functions as F
from records import RECORDS

from tableviews.operators import answers, profile, prompts, reshape
from tableviews.sources import corpus as source
from tableviews.sources import tabular


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_samples(corpus):
    _, samples, _, _ = corpus
    got = {r.sample_id: r for r in samples.collect()}
    assert sorted(got) == ["2", "s1", "s2", "s4"]
    assert got["s2"].question == "Which colour sells most?"
    assert got["2"].db == "UNKNOWN" and got["2"].question == ""
    assert got["s4"].ord == 3


def test_tables_pair_with_names_by_position(corpus):
    _, _, tables, _ = corpus
    got = {r.sample_id: r for r in tables.collect()}
    assert len(got) == 4 and got["s1"].table_name == "goods"
    assert (got["s1"].n_rows, got["s1"].n_cols) == (5, 5)
    assert got["s4"].columns == ["left", "right"]
    assert got["s4"].header_rows == [["top", ""], ["left", "right"]]
    assert got["2"].n_rows == 0


def test_cells_of_ragged_rows(corpus):
    _, _, tables, table_rows = corpus
    cells = reshape.cells_of(table_rows, tables).filter("sample_id = 's1'")
    assert cells.filter("row_pos = 2").count() == 2
    assert cells.filter("row_pos = 3").count() == 5
    typed = {(r.row_pos, r.column): (r.value, r.vtype) for r in cells.collect()}
    assert typed[(0, "price")] == ("10.0", "DOUBLE")
    assert typed[(3, "price")] == ("40", "BIGINT")
    assert typed[(0, "sold")] == ("True", "BOOLEAN")
    assert typed[(1, "stock")] == (None, "VOID")


def test_nested_content_keeps_types(corpus):
    _, _, tables, table_rows = corpus
    nested = reshape.nested_content(table_rows.filter("sample_id = 's1'")).select(F.to_json("table_content").alias("j")).collect()
    assert json.loads(nested[0].j) == RECORDS[0]["tables"][0]["table_content"]
    assert tabular.nested_tables(tables, table_rows).count() == 4


def test_parts_keep_every_row(corpus):
    _, _, _, table_rows = corpus
    parts = reshape.nested_content(table_rows, rows_per_part=2).filter("sample_id = 's1'")
    assert rows(parts, "part", F.size("table_content")) == [(0, 2), (1, 2), (2, 1)]


def test_json_lines_keep_input_order(spark, tmp_path):
    for f in range(3):
        lines = "\n".join(json.dumps({"id_": f"{f}-{i}"}) for i in range(50))
        (tmp_path / f"part{f}.jsonl").write_text(lines + "\nnot json\n\n")
    read = source.read_json_lines(spark, str(tmp_path), rejected="rows")
    got = [r.id for r in read.filter("rejected IS NULL").select("ord", reshape.record_id().alias("id")).orderBy("ord").collect()]
    assert got == [f"{f}-{i}" for f in range(3) for i in range(50)]
    assert [r.rejected for r in read.filter("rejected IS NOT NULL").collect()] == ["not json"] * 3
    with pytest.raises(Exception, match="is no JSON"):
        source.read_json_lines(spark, str(tmp_path)).select(F.to_json("record")).collect()


def test_malformed_lists_are_errors_and_nan_is_read(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"id_": 1},, {"id_": 2}]')
    with pytest.raises(Exception, match="holds no JSON list"):
        source.read_json_array(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "nan.json").write_text('[{"id_": "x", "v": NaN}]')
    (tmp_path / "nan.jsonl").write_text('{"id_": "x", "v": NaN}')
    both = [source.read_json_array(spark, str(tmp_path / "nan.json")), source.read_json_lines(spark, str(tmp_path / "nan.jsonl"))]
    assert [df.select(reshape.field("v").alias("v")).first().v for df in both] == ["NaN", "NaN"]
    # no file is too large for its list to be read
    assert source.read_json_array(spark, str(tmp_path / "nan.json"), block_bytes=5).count() == 1


def test_question_splits(spark, tmp_path):
    for name in ("train", "dev"):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"db_id": "d", "question": "q", "SQL": "SELECT 1"}, {"question_id": 7, "db_id": "d", "SQL": "x"}]))
    got = source.read_questions(spark, {n: str(tmp_path / f"{n}.json") for n in ("train", "dev")})
    assert rows(got, "sample_id") == [("dev_0",), ("dev_7",), ("train_0",), ("train_7",)]


def test_csv_round_trip(spark, corpus, tmp_path):
    _, _, tables, _ = corpus
    used = profile.column_usage(tables)
    path = str(tmp_path / "profile")
    tabular.write_csv(tabular.printable_profile(used), path, ["table"])
    back = tabular.read_profile(spark, path)
    assert {r.match_rate for r in back.filter("db = 'shop'").collect()} == {"66.67%"}
    assert back.filter("db = 'office'").collect()[0].matched_columns == []


def test_metadata_and_prompts(spark, tmp_path):
    meta = [{"db_id": "d", "table_names_original": ["A", "b"], "column_names_original": [[-1, "*"], [0, "x"], [1, "y"], [0, "z"]], "primary_keys": [1, [2, 3]], "foreign_keys": [[1, 2]]}]
    (tmp_path / "m.json").write_text(json.dumps(meta))
    from tableviews.operators.selection import columns_of_table, with_database_keys

    read = tabular.read_metadata(spark, {"train": str(tmp_path / "m.json")})
    assert rows(columns_of_table(read), "table_name", "columns") == [("A", ["x", "z"]), ("b", ["y"])]
    queries = spark.createDataFrame([("q1", "d"), ("q2", "none")], "sample_id string, db string")
    assert rows(with_database_keys(queries, read), "sample_id", "primary_keys", "foreign_keys") == [("q1", "[1,[2,3]]", "[[1,2]]"), ("q2", "[]", "[]")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "three.txt").write_text("Ask {db}\n{{x}}")
    assert rows(tabular.read_prompt_variants(spark, str(tmp_path / "p")), "variant", "template") == [("three", "Ask {db}\n{{x}}")]


def test_usage_and_examples(corpus):
    _, _, tables, table_rows = corpus
    used = {(r.db, r.table_name): r for r in profile.column_usage(tables).collect()}
    assert used[("shop", "goods")].matched_columns == ["colour", "name", "price", "stock"]
    assert used[("office", "goods")].match_rate == 0.0
    first = {(r.db, r.column): r.examples for r in profile.column_examples(table_rows, tables).collect()}
    assert first[("shop", "name")] == ["lamp", "chair"]
    assert first[("shop", "colour")] == ["red", "blue", "green"]
    assert first[("UNKNOWN", "a")] == []
    again = {(r.db, r.column): r.examples for r in profile.column_examples(table_rows, tables, retry=True).collect()}
    assert again[("shop", "note, long")] == ["a {colour} desk", "x"]
    named = profile.column_usage(tables, by_name=True).filter("table_name = 'goods'").collect()[0]
    assert named.db == "office" and "left" in named.unmatched_columns


def test_types(corpus):
    _, _, tables, table_rows = corpus
    kinds = {(r.sample_id, r.column): r.sql_type for r in profile.column_types(reshape.cells_of(table_rows, tables)).collect()}
    assert kinds[("s1", "price")] == "REAL" and kinds[("s1", "stock")] == "INTEGER" and kinds[("s1", "sold")] == "INTEGER"
    assert kinds[("s4", "left")] == "INTEGER" and kinds[("s1", "name")] == "TEXT"


def test_answers(corpus):
    _, samples, tables, table_rows = corpus
    found = answers.answer_lookups(samples, tables, table_rows)
    assert rows(found, "sample_id", "row_pos", "answer") == [("s1", 1, ["12.5"]), ("s1", 2, [None])]
    groups = answers.answer_aggregates(samples, tables, table_rows)
    assert rows(groups, "sample_id", "answer", "value") == [("s2", ["red"], 5.0)]
    quality = answers.answer_quality(answers.recompute_answers(samples, tables, table_rows))
    assert rows(quality, "sample_id", "ok", "meaningful") == [("s1", False, True), ("s2", True, True)]


def test_rendering(corpus):
    _, samples, tables, table_rows = corpus
    md = {r.sample_id: r.markdown for r in prompts.render_tables(table_rows, tables).collect()}
    assert md["2"] == "### Table: empty\n\n| a |\n| --- |"
    assert md["s1"].splitlines()[4:6] == ["| lamp | red | 10.0 | 3 | True |", "| lamp | blue | 12.5 | None | False |"]
    segments = reshape.texts_of(corpus[0])
    views = {(r.sample_id, r.view): r for r in prompts.qa_views(samples, tables, table_rows, segments, budget=130).collect()}
    assert len(views) == 12
    text = views[("s4", "unstructured")].prompt
    assert "[Textual Information]\nOne. Two.\n\n[Question]\n?" in text
    assert views[("s4", "unstructured")].n_tokens_est == -(-len(text) // 4)
    assert views[("s1", "structured")].error == "prompt_too_long" and "| lamp | red |" in views[("s1", "structured")].prompt


def test_sizes_agree_with_rendered_prompts(corpus):
    _, samples, tables, table_rows = corpus
    segments = reshape.texts_of(corpus[0])
    for r in prompts.qa_views(samples, tables, table_rows, segments).collect():
        assert r.n_tokens_est == -(-len(r.prompt) // 4), (r.sample_id, r.view)


def test_previews(corpus):
    _, _, tables, table_rows = corpus
    cells = reshape.cells_of(table_rows, tables)
    got = {r.sample_id: r.schema_md for r in prompts.schema_previews(table_rows, tables, cells).collect()}
    assert got["s2"].splitlines()[1] == "| name (TEXT) | colour (TEXT) | price (INTEGER) | stock (INTEGER) | note, long (TEXT) |"
    assert len(got["s1"].splitlines()) == 6
    assert got["2"] == "Table empty\n| a (TEXT) |\n| --- |\n"


def test_sinks(spark, corpus, tmp_path):
    _, samples, tables, table_rows = corpus
    source.write_normalized({"tables": tables.drop("content"), "rows": table_rows}, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n" / "rows")).count() == table_rows.count()
    gated = samples.withColumn("ok", F.col("sql").isNotNull())
    source.write_gated(gated, "ok", str(tmp_path / "g"))
    assert rows(spark.read.json(str(tmp_path / "g")).groupBy("outcome").count(), "outcome", "count") == [("failed", 1), ("kept", 3)]
    source.write_json_lines(tabular.nested_tables(tables, table_rows), str(tmp_path / "j"))
    back = source.read_json_lines(spark, str(tmp_path / "j")).select(reshape.field("table_content[0][2]", "string").alias("c"))
    assert back.filter("c IN ('10', '99')").count() == 2


def test_splits_and_versions(spark, tmp_path):
    record = {"id_": "a", "table_names": ["t"], "tables": [{"table_columns": ["x"], "table_content": [[1]]}],
              "raw_tables": {"table_names": ["t", "u"], "tables": [{"table_columns": ["x", "y"], "table_content": [[1, 2], [3, 4]]}]}}
    for name in ("one", "two"):
        (tmp_path / f"{name}.json").write_text(json.dumps([record]))
    read = source.read_splits(spark, {n: str(tmp_path / f"{n}.json") for n in ("one", "two")})
    assert rows(read, "split") == [("one",), ("two",)]
    assert rows(reshape.samples_of(read), "sample_id") == [("one_a",), ("two_a",)]
    assert read.select("ord").distinct().count() == 2
    assert rows(reshape.unpaired(read, "raw_tables"), "sample_id", "n_names", "n_tables") == [("one_a", 2, 1), ("two_a", 2, 1)]
    assert rows(reshape.tables_of(read, "raw_tables"), "n_rows", "n_cols") == [(2, 2), (2, 2)]
    assert rows(reshape.tables_of(read), "n_rows", "n_cols") == [(1, 1), (1, 1)]
