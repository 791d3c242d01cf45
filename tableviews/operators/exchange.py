"""Model calls as tables: requests go out, replies come back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tableviews.functions.cells import is_blank
from tableviews.functions.text import token_estimate

NO_REPLY = "no_reply"
# What a missing reply of each kind turns into.
FALLBACKS = {"columns": "", "templates": "ERROR", "answer": None, "sql": None, "repair": None, "judge": "ERROR: no_reply"}


def request_id(kind: str, *key: Column | str) -> Column:
    """Stable id of a request, so that a repeated run meets its old replies.

    The key is hashed as a JSON list, so keys with gaps or with separators inside stay apart.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.to_json(F.array(F.lit(kind), *[c.cast("string") for c in cols])))


def make_requests(df: DataFrame, kind: str, key: list[str], prompt: Column, n_tokens: Column | None = None) -> DataFrame:
    """One row per prompt: (request_id, kind, key columns, prompt, n_tokens_est)."""
    estimate = token_estimate(F.length(prompt)) if n_tokens is None else n_tokens
    return df.select(
        request_id(kind, *key).alias("request_id"), F.lit(kind).alias("kind"), *key, prompt.alias("prompt"), estimate.alias("n_tokens_est")
    )


def attach_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Join replies (request_id, text) to their requests.

    A missing or blank reply sets ``error`` and leaves the fallback of its kind.
    Of several replies to one request one is kept, so no request is doubled; a blank one
    only if there is no other.
    """
    single = replies.filter(~is_blank(F.col("text"))).groupBy("request_id").agg(F.min("text").alias("text"))
    joined = requests.join(single, "request_id", "left")
    silent = F.col("text").isNull() | (F.trim("text") == "")
    fallback = F.element_at(F.create_map(*[F.lit(x) for kv in FALLBACKS.items() for x in (kv[0], kv[1] or "")]), F.col("kind"))
    return joined.withColumn("error", F.when(silent, NO_REPLY)).withColumn(
        "text", F.when(silent, F.nullif(fallback, F.lit(""))).otherwise(F.col("text"))
    )


def complete_with(requests: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """Answer requests with a user function over batches of prompts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"request_id": batch["request_id"], "text": fn(batch["prompt"].tolist())})

    return requests.select("request_id", "prompt").mapInPandas(run, "request_id string, text string")
