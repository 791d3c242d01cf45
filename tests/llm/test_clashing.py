"""Columns of users whose names the stages use inside."""

import pytest
from pyspark.sql import functions as F

from tableviews.llm import decontamination, jaccard_join, shared, source_mixing, token_files

EXTRA = ["topic", "__doc", "__id", "__tag", "__key", "__topic", "__given", "doc", "rep", "class", "k1", "leaf", "gone"]


@pytest.fixture(scope="module")
def docs(spark):
    shared.ship_package(spark)
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text), (2, text), (3, " ".join(f"other{k}" for k in range(40))), (None, "alone here"), (5, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    return frame.withColumns({name: F.lit("a text") for name in EXTRA})


def test_one_of_each_class(docs):
    kept = jaccard_join.one_of_each_class(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 5]
    twice = docs.unionAll(docs.filter("doc_id = 3").withColumn("text", F.lit("a third text of its own")))
    assert jaccard_join.one_of_each_class(twice).count() == 5


def test_a_topic_of_texts_is_only_a_column(docs):
    rows = source_mixing.mixture(docs).collect()
    assert len(rows) == 5 and all(0 <= r.topic < source_mixing.TOPICS for r in rows)
    assert source_mixing.sample_mixture(docs).columns == docs.columns
    # named as the topic, what is no whole number is a topic of its own
    given = docs.withColumn("topic", F.when(F.col("doc_id") == 1, "4").otherwise(F.col("topic")))
    assert {(r.doc_id, r.topic) for r in source_mixing.mixture(given, topic="topic").collect()} == {(1, 4), (2, -1), (3, -1), (None, -1), (5, -1)}


def test_clean_documents_and_token_files(docs, spark):
    benchmark = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(20)))], "item_id long, text string")
    kept = decontamination.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 5]
    assert token_files.token_file_rows(docs).count() == 5
