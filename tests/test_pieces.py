"""Lists and CSV files read by blocks, against the whole file read at once."""

import csv
import json
import random

import pytest

from tableviews.sources import corpus, tabular

MARKS = ["a", '"', "\\", "{", "}", "[", "]", ",", "é", "\n", "漢", ":", " "]


def records(seed, n):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choices(MARKS, k=draw.randrange(0, 12)))
    return [{"id": k, text() + "k": text(), "rows": [[{"x": "}"}, text()], []][: draw.randrange(3)]} for k in range(n)]


@pytest.mark.parametrize("block_bytes, n", [(7, 2), (64, 12), (4096, 300), (None, 300)])
def test_a_list_by_blocks_holds_the_records_of_the_whole(spark, tmp_path, block_bytes, n):
    path = tmp_path / "list.json"
    wanted = records(n, n)
    path.write_text(f" {json.dumps(wanted, indent=1, ensure_ascii=False)}\n", encoding="utf-8")
    got = corpus.read_json_array(spark, str(path), block_bytes=block_bytes).selectExpr("ord", "to_json(record) AS j").orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(n))
    assert [json.loads(r.j) for r in got] == wanted


def test_several_files_go_on_in_the_order_of_names(spark, tmp_path):
    for name, rows in (("b", records(1, 3)), ("a", records(2, 4)), ("c", []), ("d", records(3, 1))):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    got = corpus.read_json_array(spark, str(tmp_path), block_bytes=40).selectExpr("ord", "to_json(record) AS j").orderBy("ord").collect()
    assert [(r.ord, json.loads(r.j)) for r in got] == list(enumerate(records(2, 4) + records(1, 3) + records(3, 1)))


def test_several_tasks_read_a_list_and_no_setting_stays_changed(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text(json.dumps(records(5, 200)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = corpus.read_json_array(spark, str(path), block_bytes=1024)
    assert len(found.select("ord").inputFiles()) > 3
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before and spark.conf.get("spark.sql.files.minPartitionNum", None) is None


@pytest.mark.parametrize("text", ["  ", '{"a":1}', '[{"a":1}', "[1,2]", '[{"a":1},]', '[{"a":1},,{"a":2}]', '[{"a":1} {"a":2}]', '[{"a":1}]]', '[{"a":"}]', '[{"a":1}, 2]', '[{"a":nope}]', '[[{"a":1}]]'])
def test_what_is_no_list_of_objects_is_an_error(spark, tmp_path, text):
    path = tmp_path / "list.json"
    path.write_text(text, encoding="utf-8")
    with pytest.raises(Exception, match="no JSON (list|object)"):
        corpus.read_json_array(spark, str(path), block_bytes=8).selectExpr("to_json(record)").collect()


def test_an_empty_list(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text(" [ ]\n", encoding="utf-8")
    assert corpus.read_json_array(spark, str(path)).collect() == []


def test_a_list_that_was_written(spark, tmp_path):
    rows = spark.range(30).selectExpr("id AS ord", "id % 3 AS a", "concat('}]\"', id) AS b")
    corpus.write_json_array(rows, str(tmp_path / "out"), "ord")
    got = corpus.read_json_array(spark, str(tmp_path / "out"), block_bytes=50)
    assert sorted((r.ord, r.b) for r in got.selectExpr("ord", "try_variant_get(record, '$.b', 'string') AS b").collect()) == [(k, f'}}]"{k}') for k in range(30)]


def test_records_of_a_list_are_made_by_several_tasks(spark, tmp_path, monkeypatch):
    stored, shared = corpus.stored, tmp_path / "shared"
    monkeypatch.setattr(corpus, "stored", lambda df, **options: stored(df, folder=str(shared), **options))
    rows = spark.range(0, 400, 1, 4).selectExpr("id AS ord", "concat('a \"', id) AS said")
    corpus.write_json_array(rows, str(tmp_path / "out"), "ord")
    # the lines, packed, by all tasks; the list, in order, in one file
    assert len(list(shared.glob("tableviews-*/part-*.parquet"))) == 4
    (whole,) = (tmp_path / "out").glob("part-*")
    assert [r["said"] for r in json.loads(whole.read_text())] == [f'a "{k}' for k in range(400)]


def written(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        csv.writer(file, lineterminator=end).writerows(rows)


@pytest.mark.parametrize("block_bytes, n", [(7, 4), (64, 30), (4096, 400), (None, 400)])
def test_csv_by_blocks_holds_the_rows_of_sparks_reader(spark, tmp_path, block_bytes, n):
    draw = random.Random(n)
    cell = lambda: "".join(draw.choices(["a", '"', '""', ",", "\n", "\n\n", "é", " "], k=draw.randrange(0, 7)))
    written(tmp_path / "t.csv", [["i", "t`x", "odd, name"], *[[k, cell(), draw.choice(["", "p", 'q"q', '"'])] for k in range(n)]])
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(tmp_path))
    got = tabular.read_csv(spark, str(tmp_path), block_bytes=block_bytes)
    assert got.columns == whole.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)


def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n5" pipe,x\n"1\n2",y"z\n,"""q"\n', encoding="utf-8")
    got = tabular.read_csv(spark, str(tmp_path), block_bytes=5)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([('5" pipe', "x"), ("1\n2", 'y"z'), (None, '"q')], key=repr)


def test_other_line_ends_and_each_files_header(spark, tmp_path):
    written(tmp_path / "1.csv", [["a", "b"], ["1", "x\ny"], ["2", ""]], "\r\n")
    written(tmp_path / "2.csv", [["a", "b"], ["3", "z"]])
    (tmp_path / "3.csv").write_text("a,b", encoding="utf-8")
    got = tabular.read_csv(spark, str(tmp_path), block_bytes=6)
    assert sorted(map(tuple, got.collect())) == [("1", "x\ny"), ("2", None), ("3", "z")]


def test_an_open_cell_at_the_end_is_an_error(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"open\n2,x\n', encoding="utf-8")
    with pytest.raises(ValueError, match="quoted cell"):
        tabular.read_csv(spark, str(tmp_path))
