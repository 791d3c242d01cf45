"""Exact and partial match, judge verdicts, and how two runs differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tableviews.functions.replies import CORRECT, exact_match, judge_label, partial_match


def score(results: DataFrame, pred: str = "prediction_norm", truth: str = "truth_norm", error: str = "error") -> DataFrame:
    """Add ``em``, ``pm`` and ``pm_strict`` from two normalized texts; an error scores 0."""
    p, g, e = F.col(pred), F.col(truth), F.col(error)
    return results.withColumns(
        {"em": exact_match(p, g, e), "pm": partial_match(p, g, e), "pm_strict": partial_match(p, g, e, strict=True)}
    )


def score_totals(scored: DataFrame, *by: str) -> DataFrame:
    """Number of results, summed and mean matches per group."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum("em").alias("em"),
        F.sum("pm").alias("pm"),
        F.avg("em").alias("em_rate"),
        F.avg("pm").alias("pm_rate"),
    )


def judged(results: DataFrame, reply: str = "text") -> DataFrame:
    """Add the judge's label."""
    return results.withColumn("judge_label", judge_label(F.col(reply)))


def judge_accuracy(labelled: DataFrame, *by: str) -> DataFrame:
    """Share of CORRECT among all judged; everything else, errors too, counts as wrong."""
    right = (F.col("judge_label") == CORRECT).cast("int")
    return labelled.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(right), F.lit(0)).alias("n_correct"),
        F.coalesce(F.avg(right), F.lit(0.0)).alias("accuracy"),
    )


def outcome_counts(results: DataFrame) -> DataFrame:
    """Results without and with an error text."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    return results.agg(
        F.count_if(~failed).alias("n_ok"),
        F.count_if(failed).alias("n_failed"),
    )


def run_delta(run_a: DataFrame, run_b: DataFrame, *by: str) -> DataFrame:
    """Pair two runs by sample and report the mean scores and their difference (a - b)."""
    a = run_a.select("sample_id", *by, F.col("em").alias("em_a"), F.col("pm").alias("pm_a"))
    b = run_b.select("sample_id", F.col("em").alias("em_b"), F.col("pm").alias("pm_b"))
    return a.join(b, "sample_id").groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("em_a").alias("em_rate_a"),
        F.avg("em_b").alias("em_rate_b"),
        (F.avg("em_a") - F.avg("em_b")).alias("em_delta"),
        (F.avg("pm_a") - F.avg("pm_b")).alias("pm_delta"),
    )
