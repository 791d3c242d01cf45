"""Columns that read model replies: fences, JSON, labels, answers, SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tableviews.functions.binding import bind
from tableviews.functions.cells import flat_values, variant_text, variant_type

# The fences and keys that replies are written with.
JSON_FENCE = r"(?s)```json\s*(.*?)\s*```"
SQL_FENCE = r"(?is)```sql(.*?)```"
LEADING_FENCE = r"(?i)^```(?:json)?\s*"
TRAILING_FENCE = r"\s*```$"
NOTE = r"(?is)<!--note-->(.*)$"
ANSWER_KEYS = ["Answer", "answer"]
EXTRACT_FAILED = "extract_failed"
CORRECT = "CORRECT"


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fenced_json(text: Column) -> Column:
    """Content of the first JSON fence, or the whole text."""
    return F.when(text.rlike(JSON_FENCE), F.regexp_extract(text, JSON_FENCE, 1)).otherwise(strip(text))


def without_fence(text: Column) -> Column:
    """Text without a fence mark at its start and at its end."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), LEADING_FENCE, ""), TRAILING_FENCE, ""))


def parse_label_reply(text: Column) -> Column:
    """Reply to struct(labels MAP<STRING,STRING>, combinations ARRAY<ARRAY<STRING>>, failed).

    A list counts as its first element.  Inside combinations only texts and
    integers are names.  When neither field holds anything the reply failed.
    """
    no_labels = F.create_map().cast("map<string,variant>")
    no_lists = F.array().cast("array<variant>")

    def labels(v: Column) -> Column:
        found = F.coalesce(F.try_variant_get(v, "$.column_classification", "map<string,variant>"), no_labels)
        return F.transform_values(found, lambda _, x: F.coalesce(variant_text(x), F.lit("None")))

    def names(xs: Column) -> Column:
        return F.transform(F.filter(xs, lambda x: variant_type(x).isin("STRING", "BIGINT", "BOOLEAN")), lambda x: variant_text(x))

    def combinations(v: Column) -> Column:
        found = F.coalesce(F.try_variant_get(v, "$.combinations", "array<variant>"), no_lists)
        lists = F.transform(found, lambda x: F.try_variant_get(x, "$", "array<variant>"))
        return F.transform(F.filter(lists, lambda x: x.isNotNull()), names)

    def with_outcome(r: Column) -> Column:
        return F.struct(
            r["labels"].alias("labels"),
            r["combinations"].alias("combinations"),
            ((F.size(r["labels"]) == 0) & (F.size(r["combinations"]) == 0)).alias("failed"),
        )

    first = lambda v: F.when(variant_type(v) == "ARRAY", F.try_variant_get(v, "$[0]", "variant")).otherwise(v)
    read = lambda v: F.struct(labels(v).alias("labels"), combinations(v).alias("combinations"))
    return bind(bind(bind(F.try_parse_json(fenced_json(text)), first), read), with_outcome)


def parse_template_reply(text: Column, n: int = 5) -> Column:
    """Reply to ARRAY<STRING> of n templates; NULL where the reply is not a JSON object."""
    read = lambda v: F.array(*[F.try_variant_get(v, f"$.template{i}", "string") for i in range(1, n + 1)])
    return bind(F.try_parse_json(without_fence(text)), lambda v: F.when(variant_type(v) == "OBJECT", read(v)))


def parse_list_field(text: Column) -> Column:
    """A list written as JSON or with commas; blanks are dropped."""
    def parts(t: Column) -> Column:
        listed = F.try_variant_get(F.try_parse_json(t), "$", "array<variant>")
        from_json = F.when(t.rlike(r"(?s)^\[.*\]$"), F.transform(listed, lambda v: F.coalesce(variant_text(v), F.lit("None"))))
        return F.filter(F.transform(F.coalesce(from_json, F.split(t, ",")), strip), lambda p: p != "")

    return F.coalesce(bind(strip(text), parts), F.array().cast("array<string>"))


def extract_answer(text: Column) -> Column:
    """Reply to struct(prediction, error).

    The answer is the text under one of the answer keys.  A JSON list or object without
    them gives the text inside the fence, anything else the whole reply, both as failures.
    """
    def inner(raw: Column) -> Column:
        fenced = strip(F.regexp_replace(F.substring(raw, 8, 2147483647), "```$", ""))
        return F.when(F.startswith(raw, F.lit("```json")), fenced).otherwise(raw)

    def found(v: Column) -> Column:
        keyed = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in ANSWER_KEYS])
        return F.when(variant_type(v) == "OBJECT", keyed)

    def result(raw: Column, body: Column, v: Column, answer: Column) -> Column:
        nested = F.coalesce(variant_type(v).isin("ARRAY", "OBJECT", "STRING"), F.lit(False))
        fallback = F.when(v.isNotNull() & nested, body).otherwise(raw)
        shown = F.lower(strip(F.coalesce(variant_text(answer), F.lit("None"))))
        return F.struct(
            F.when(answer.isNotNull(), shown).otherwise(fallback).alias("prediction"),
            F.when(answer.isNull(), EXTRACT_FAILED).alias("error"),
        )

    return bind(
        strip(text),
        lambda raw: bind(
            inner(raw),
            lambda body: bind(F.try_parse_json(body), lambda v: bind(found(v), lambda a: result(raw, body, v, a))),
        ),
    )


def normalize_answer(v: Column) -> Column:
    """Comparable text of an answer held as VARIANT.

    Lists are flattened and joined by spaces, objects become JSON with sorted
    keys, everything is lower-cased.
    """
    def by_kind(kind: Column) -> Column:
        joined = F.array_join(F.transform(flat_values(v), lambda x: F.coalesce(variant_text(x), F.lit("None"))), " ")
        # a space after every comma and colon that stands outside of quotes
        spaced = F.regexp_replace(F.to_json(v), r'((?:"(?:[^"\\]|\\.)*"|[^":,])*)([:,])', "$1$2 ")
        plain = F.coalesce(variant_text(v), F.lit("None"))
        return F.lower(F.when(kind == "ARRAY", joined).when(kind == "OBJECT", spaced).otherwise(plain))

    return bind(variant_type(v), by_kind)


def judge_text(v: Column) -> Column:
    """Answer as written into a judge prompt: list elements stripped and joined by commas."""
    joined = F.array_join(F.transform(flat_values(v), lambda x: strip(F.coalesce(variant_text(x), F.lit("None")))), ", ")
    return F.when(variant_type(v) == "ARRAY", joined).otherwise(strip(F.coalesce(variant_text(v), F.lit("None"))))


def exact_match(pred: Column, truth: Column, error: Column) -> Column:
    return F.when(error.isNull(), F.coalesce((pred == truth).cast("int"), F.lit(0))).otherwise(0)


def partial_match(pred: Column, truth: Column, error: Column, strict: bool = False) -> Column:
    """Either text contains the other; ``strict`` asks that both are non-empty."""
    hit = F.contains(pred, truth) | F.contains(truth, pred)
    if strict:
        hit = hit & (pred != "") & (truth != "")
    return F.when(error.isNull(), F.coalesce(hit.cast("int"), F.lit(0))).otherwise(0)


def judge_label(reply: Column) -> Column:
    return F.upper(strip(reply))


def sql_note(text: Column) -> Column:
    """Text after the note mark, NULL without one."""
    return F.when(text.rlike(NOTE), strip(F.regexp_extract(text, NOTE, 1)))


def sql_without_note(text: Column) -> Column:
    return F.when(text.rlike(NOTE), strip(F.regexp_replace(text, NOTE, ""))).otherwise(text)


def guard_sql(text: Column) -> Column:
    """Reply to struct(sql, error): the fenced statement if there is one, SELECT only."""
    body = F.when(text.rlike(SQL_FENCE), strip(F.regexp_extract(text, SQL_FENCE, 1))).otherwise(strip(text))

    def checked(sql: Column) -> Column:
        ok = sql.rlike(r"(?is)^\(*\s*select")
        return F.struct(
            F.when(ok, F.concat(sql, F.lit(";"))).alias("sql"), F.when(~ok, "Only SELECT is allowed.").alias("error")
        )

    return bind(F.btrim(body, F.lit(";")), checked)
