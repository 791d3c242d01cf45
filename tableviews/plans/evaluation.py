"""Runs: question answering, text-to-SQL and judging, from requests to scores."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from tableviews.functions import replies
from tableviews.functions.binding import with_computed
from tableviews.functions.cells import has_value, is_falsy
from tableviews.operators import exchange, ledger, prompts, scoring
from tableviews.session import stored


def qa_requests(views: DataFrame) -> DataFrame:
    """Requests of the views that are within the budget, if one was set."""
    fitting = views.filter(F.col("error").isNull())
    return exchange.make_requests(fitting, "answer", ["sample_id", "view"], F.col("prompt"), F.col("n_tokens_est"))


def qa_results(views: DataFrame, samples: DataFrame, answered: DataFrame) -> DataFrame:
    """Scored results per sample and view.

    ``samples`` holds the ``answer`` as VARIANT; those without are left out.  Prompts
    beyond the budget are results with an error and score 0.
    """
    keyed = views.select("sample_id", "view", "n_tokens_est", F.col("error").alias("skipped")).withColumns(
        {"kind": F.lit("answer"), "request_id": exchange.request_id("answer", "sample_id", "view")}
    )
    back = with_computed(exchange.attach_replies(keyed, answered), "__a", replies.extract_answer(F.coalesce("text", F.lit(""))))
    error = F.coalesce("skipped", "error", "__a.error")
    prediction = (
        F.when(F.col("skipped").isNotNull(), prompts.skipped_prediction(F.col("n_tokens_est")))
        .when(F.col("error").isNotNull(), None)
        .otherwise(F.col("__a.prediction"))
    )
    read = back.select("sample_id", "view", prediction.alias("prediction"), error.alias("error"))
    known = samples.filter(has_value(F.col("answer"))).select(
        "sample_id", "question", "answer", F.to_json("answer").alias("ground_truth"), replies.normalize_answer(F.col("answer")).alias("truth_norm")
    )
    joined = read.join(known, "sample_id").withColumn("prediction_norm", F.lower("prediction"))
    return scoring.score(joined).drop("prediction_norm", "truth_norm")


class PairedRun(NamedTuple):
    """Scored results on the chosen view and on the raw tables, and what was sent for both."""

    results: DataFrame
    raw_results: DataFrame
    sent: ledger.Sent


def paired_run(
    samples: DataFrame,
    tables: DataFrame,
    rows: DataFrame,
    segments: DataFrame,
    raw_tables: DataFrame,
    raw_rows: DataFrame,
    fn: Callable[[list[str]], list[str | None]],
    folder: str,
    view: str = "semi-structured",
    raw_view: str = "structured",
    budget: int | None = None,
) -> PairedRun:
    """Ask every sample on one view of its tables and on its raw tables, with one ledger for both.

    Prompts that are equal, in both runs or in an earlier one, are sent once; a run that stopped goes on with what has no
    reply yet.  `scoring.run_delta` compares the two results.
    """
    no_text = segments.limit(0)
    asked = [
        stored(prompts.qa_views(samples, tables, rows, segments, [view], budget)),
        stored(prompts.qa_views(samples, raw_tables, raw_rows, no_text, [raw_view], budget)),
    ]
    requests = [qa_requests(views) for views in asked]
    sent = ledger.send(requests[0].unionByName(requests[1]), folder, fn)
    results = [qa_results(views, samples, ledger.answered(own, folder)) for views, own in zip(asked, requests, strict=True)]
    return PairedRun(results[0], results[1], sent)


def sql_requests(samples: DataFrame, previews: DataFrame, today: str, dialect: str = "Spark SQL") -> DataFrame:
    """Text-to-SQL requests with their messages."""
    asked = samples.join(previews, "sample_id", "left").withColumn(
        "messages", prompts.sql_messages(F.col("schema_md"), F.col("question"), today, dialect)
    )
    return exchange.make_requests(asked, "sql", ["sample_id"], F.to_json("messages"))


def sql_statements(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """Statements out of text-to-SQL replies: (sample_id, sql, note, statement, error)."""
    back = exchange.attach_replies(requests, answered)
    pure = replies.strip(replies.sql_without_note(F.coalesce("text", F.lit(""))))
    guarded = replies.guard_sql(replies.sql_without_note(F.coalesce("text", F.lit(""))))
    return back.select(
        "sample_id", pure.alias("sql"), replies.sql_note(F.col("text")).alias("note"), guarded.alias("g"), F.col("error").alias("lost")
    ).select("sample_id", "sql", "note", F.col("g.sql").alias("statement"), F.coalesce("lost", "g.error").alias("error"))


def repair_requests(requests: DataFrame, failed: DataFrame, dialect: str = "Spark SQL") -> DataFrame:
    """One more round for statements that failed: ``failed`` is (sample_id, sql, error)."""
    ddl = "array<struct<role:string,content:string>>"
    joined = requests.select("sample_id", F.from_json("prompt", ddl).alias("messages")).join(failed, "sample_id")
    again = joined.withColumn("messages", prompts.repair_messages(F.col("messages"), F.col("sql"), F.col("error"), dialect))
    return exchange.make_requests(again, "repair", ["sample_id"], F.to_json("messages"))


def sql_rounds(
    samples: DataFrame,
    previews: DataFrame,
    fn: Callable[[list[str]], list[str | None]],
    folder: str,
    today: str,
    dialect: str = "Spark SQL",
    find_errors: Callable[[DataFrame], DataFrame] | None = None,
    rounds: int = 2,
) -> DataFrame:
    """Ask for a statement for each sample, and again for those that fail: (sample_id, round, sql, note, statement, error).

    ``find_errors`` takes (sample_id, statement) of the statements that are allowed and gives (sample_id, error) of those
    that fail where they run.  A failed one goes back with its error, ``rounds`` - 1 times at most; a sample's row is that
    of its last round.  A sample without a reply has nothing to repair.  Prompts and replies are kept in a ledger below
    ``folder``, so a run that stopped goes on where it was.
    """
    requests = stored(sql_requests(samples, previews, today, dialect))
    settled: list[DataFrame] = []
    for number in range(rounds):
        ledger.send(requests, folder, fn, str(number))
        told = sql_statements(requests, ledger.answered(requests, folder))
        if find_errors is not None:
            found = find_errors(told.filter("error IS NULL").select("sample_id", "statement")).select("sample_id", F.col("error").alias("found"))
            told = told.join(found, "sample_id", "left").withColumn("error", F.coalesce("error", "found")).drop("found")
        told = stored(told.withColumn("round", F.lit(number)))
        open_ones = told.filter("error IS NOT NULL AND sql <> ''") if number + 1 < rounds else told.limit(0)
        settled.append(told.join(open_ones.select("sample_id"), "sample_id", "left_anti"))
        if open_ones.isEmpty():
            break
        requests = stored(repair_requests(requests, open_ones.select("sample_id", "sql", "error"), dialect))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("sample_id", "round", "sql", "note", "statement", "error")


def judge_requests(results: DataFrame) -> DataFrame:
    """Judge requests of all results whose truth (VARIANT ``answer``) counts, one per sample and view."""
    key = ["sample_id", "view"] if "view" in results.columns else ["sample_id"]
    counted = results.filter(~is_falsy(F.col("answer")))
    prompt = prompts.judge_prompt(F.coalesce(F.trim("prediction"), F.lit("None")), replies.judge_text(F.col("answer")))
    return exchange.make_requests(counted, "judge", key, prompt)


def judge_results(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """Verdicts; a missing one counts as wrong."""
    return scoring.judged(exchange.attach_replies(requests, answered))
