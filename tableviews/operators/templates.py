"""Column labels, column combinations and row templates that come out of replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableviews.functions.binding import with_computed
from tableviews.functions.cells import is_blank
from tableviews.functions.replies import parse_label_reply, parse_template_reply
from tableviews.functions.text import template_fits

# Fixed value: how many templates a request asks for.
N_TEMPLATES = 5
# Fixed value: what stands in for a template that could not be read.
FAILED_TEMPLATE = "ERROR"
SCOPES = ("all", "query", "other")


def columns_in_scope(scope: str = "all") -> Column:
    """Columns to ask about: all of a profile (sorted), only used, or only unused ones."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")
    return {
        "all": F.array_sort(F.array_union("matched_columns", "unmatched_columns")),
        "query": F.col("matched_columns"),
        "other": F.col("unmatched_columns"),
    }[scope]


def columns_to_verbalize() -> Column:
    """Used columns, then unused ones; every column with examples when there are none."""
    named = F.concat("matched_columns", "unmatched_columns")
    return F.when(F.size(named) > 0, named).otherwise(F.map_keys("column_examples"))


def parse_labels(replies: DataFrame, text: str = "text") -> DataFrame:
    """Add ``labels``, ``combinations`` and ``failed`` to replies per (db, table_name)."""
    parsed = with_computed(replies, "__p", parse_label_reply(F.coalesce(F.col(text), F.lit(""))))
    return parsed.select(*replies.columns, "__p.*")


def label_failures(parsed: DataFrame, text: str = "text") -> DataFrame:
    """Replies that could not be read, as they came."""
    return parsed.filter("failed").select("db", "table_name", F.col(text).alias("output"))


def label_rows(parsed: DataFrame) -> DataFrame:
    """One row per (db, table, column) with its label."""
    # failed replies have no labels; the outer form keeps Spark from reading replies once more to filter them
    rows = parsed.select("db", "table_name", F.explode_outer("labels").alias("column", "label"))
    return rows.filter(F.col("column").isNotNull())


def accepted_combinations() -> Column:
    """Non-empty combinations of which every column is labelled YES."""
    yes = F.map_keys(F.map_filter("labels", lambda _, label: F.upper(label) == "YES"))
    return F.filter("combinations", lambda c: (F.size(c) > 0) & F.forall(c, lambda x: F.array_contains(yes, x)))


def combination_rows(parsed: DataFrame) -> DataFrame:
    """One row per accepted combination, numbered inside its table."""
    rows = parsed.select("db", "table_name", F.posexplode_outer(accepted_combinations()).alias("set_no", "columns"))
    return rows.filter(F.col("set_no").isNotNull())


def widest(combinations: DataFrame) -> DataFrame:
    """Length of the longest combination, 0 without any."""
    return combinations.agg(F.coalesce(F.max(F.size("columns")), F.lit(0)).alias("n_columns"))


def widen(combinations: DataFrame, n_columns: int) -> DataFrame:
    """Combinations as ``column1 .. columnN``; short ones are padded with empty text."""
    return combinations.select(
        "db",
        "table_name",
        *[F.coalesce(F.get("columns", F.lit(i)), F.lit("")).alias(f"column{i + 1}") for i in range(n_columns)],
        *[c for c in combinations.columns if c.startswith("template")],
    )


def numbered(prefix: str, names: list[str]) -> list[str]:
    """Names such as column1, column2 .. in the order of the DataFrame."""
    return [c for c in names if c.startswith(prefix)]


def ensure_template_columns(df: DataFrame, n: int = N_TEMPLATES) -> DataFrame:
    """Add missing ``template1 .. templateN`` and bring the columns into their fixed order."""
    absent = {f"template{i}": F.lit("") for i in range(1, n + 1) if f"template{i}" not in df.columns}
    full = df.withColumns(absent) if absent else df
    columns = sorted(numbered("column", full.columns), key=lambda c: int(c.removeprefix("column")))
    return full.select("db", "table_name", *columns, *[f"template{i}" for i in range(1, n + 1)])


def attach_templates(combinations: DataFrame, text: str = "text", n: int = N_TEMPLATES) -> DataFrame:
    """Read template replies into ``template1 .. templateN``.

    A reply that is no JSON object, and a name it does not hold, give the failure mark.
    """
    parsed = with_computed(combinations, "__t", parse_template_reply(F.coalesce(F.col(text), F.lit(""))))
    return parsed.withColumns(
        {f"template{i}": F.coalesce(F.get("__t", F.lit(i - 1)), F.lit(FAILED_TEMPLATE)) for i in range(1, n + 1)}
    ).drop("__t")


def template_sets(wide: DataFrame, check: bool = True) -> DataFrame:
    """Wide rows to (db, table_name, set_no, columns, templates).

    Blank names and templates are dropped and both lists must hold something.
    ``check`` also drops templates that do not name exactly the columns, which is
    how failed replies are kept out.
    """
    def filled(names: list[str]) -> Column:
        listed = F.array(*[F.col(c).cast("string") for c in names]) if names else F.array().cast("array<string>")
        return F.filter(listed, lambda x: ~is_blank(x))

    present = sorted(numbered("template", wide.columns), key=lambda c: int(c.removeprefix("template")))
    sets = wide.select(
        "db", "table_name",
        *(["set_no"] if "set_no" in wide.columns else []),
        filled(numbered("column", wide.columns)).alias("columns"),
        filled(present).alias("templates"),
    )
    if "set_no" not in sets.columns:
        # the number only has to tell sets apart, so it is taken from their content
        sets = sets.withColumn("set_no", F.xxhash64("columns", "templates"))
    if check:
        sets = sets.withColumn("templates", F.filter("templates", lambda t: template_fits(t, F.col("columns"))))
    return sets.filter((F.size("columns") > 0) & (F.size("templates") > 0))
