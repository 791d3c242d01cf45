"""A usage profile that grows with its corpus: each batch of samples leaves its partial sums, and a profile is their merge."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tableviews.operators import profile

PARTS = ("columns", "tables", "kinds")


class ProfileState(NamedTuple):
    """Partial sums of one or several batches.

    ``columns`` is what `profile.column_stats` gives by database and table, ``tables`` counts the samples of each table
    and its rows, ``kinds`` counts the samples of each kind of query.
    """

    columns: DataFrame
    tables: DataFrame
    kinds: DataFrame


def state_of(tables: DataFrame, kinds: DataFrame, word: bool = False) -> ProfileState:
    """The state of a batch: its tables (with sql, columns and n_rows), and the kind of each of its queries (kind)."""
    counted = tables.groupBy("db", "table_name").agg(F.count("*").alias("count"), F.sum("n_rows").alias("n_rows"), F.sum("n_cols").alias("n_cols"))
    return ProfileState(profile.column_stats(tables, word), counted, kinds.groupBy("kind").agg(F.count("*").alias("count")))


def add_batch(state: ProfileState, folder: str, batch: str) -> None:
    """Put a batch's state down below a folder; the same batch again takes the place of its former state."""
    for name, part in zip(PARTS, state, strict=True):
        part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")


def merged(spark: SparkSession, folder: str) -> ProfileState:
    """The state of all batches below a folder: sums are added and extremes compared, so their order does not count."""
    columns, tables, kinds = (spark.read.parquet(f"{folder}/{name}") for name in PARTS)
    return ProfileState(
        profile.merge_stats(columns),
        tables.groupBy("db", "table_name").agg(*[F.sum(c).alias(c) for c in ("count", "n_rows", "n_cols")]),
        profile.merge_counts(kinds, "kind"),
    )


def average_size(state: ProfileState) -> DataFrame:
    """Mean rows and columns over all tables; 0 without tables."""
    n = F.sum("count")
    return state.tables.agg(*[F.coalesce(F.sum(c) / n, F.lit(0.0)).alias(name) for c, name in (("n_rows", "avg_rows"), ("n_cols", "avg_cols"))])


def kind_shares(state: ProfileState) -> DataFrame:
    """Count and share of each kind of query."""
    # kinds are few
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return state.kinds.withColumn("share", F.col("count") / total)
