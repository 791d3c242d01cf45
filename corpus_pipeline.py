"""The preparation of the documents table for training, as stages that each write what they keep."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tableviews.llm import decontamination, jaccard_join, rule_quality, source_mixing, token_files
from tableviews.llm.queries import table
from tableviews.llm.shared import ship_package
from tableviews.session import checkpoint_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents that the rule ensemble scores as good; the held-out labels stay unread."""
    ship_package(spark)
    return rule_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the smallest document of every near-duplicate class."""
    ship_package(spark)
    return jaccard_join.one_of_each_class(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents in which no benchmark passage was found."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def draw_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: documents drawn by the calibrated probabilities of their source, language and topic."""
    ship_package(spark)
    return source_mixing.sample_mixture(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: the token ids of the documents in seekable files, one row for each document."""
    ship_package(spark)
    return token_files.token_file_rows(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", keep_clean),
    ("source_mixing", draw_mixture),
    ("token_files", write_tokens),
]

# A trained classifier, random projections and files of frames are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
