"""Builders of diagnostic subsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tableviews.functions.binding import with_computed
from tableviews.functions.markdown import parse_table
from tableviews.operators import selection
from tableviews.operators.ordering import spread_join

# Names in the question files of Markdown tables.
SIMPLE_TASK = "简单查询"
NESTED_TYPES = ["嵌套表格", "层次表格"]
ANSWER_LIST = "问题列表"
FINAL_ANSWER = "最终答案"


def catalog_subsets(
    questions: DataFrame,
    counts: DataFrame,
    short_max: int = selection.SHORT_MAX_ROWS,
    long_min: int = selection.LONG_MIN_ROWS,
) -> DataFrame:
    """Single-table questions on catalog tables with their ``subset``.

    Every text is tagged once and labelled by length and shape, so that all subsets
    come from one scan; write the result with ``partitionBy("subset")``.
    """
    tagged = selection.with_row_counts(selection.tag_queries(questions), counts)
    return tagged.withColumn("subset", selection.subset_label(short_max, long_min)).filter(F.col("subset").isNotNull())


def answered_subset(subset: DataFrame, quality: DataFrame, per_type: int | None = None, seed: int = 42) -> DataFrame:
    """Questions whose answer says something, with ``per_type`` at most so many of each type."""
    meaningful = quality.filter("meaningful").select("sample_id")
    kept = subset.join(meaningful, "sample_id", "left_semi")
    return kept if per_type is None else selection.sample_per_type(kept, per_type, seed)


def markdown_subset(
    questions: DataFrame,
    meta: DataFrame,
    min_rows: int = 0,
    max_rows: int | None = selection.SHORT_MAX_ROWS,
    sub_task: str = SIMPLE_TASK,
    excluded: Sequence[str] = NESTED_TYPES,
) -> DataFrame:
    """Questions of one sub-task on flat Markdown tables of a given length.

    ``questions`` is (sample_id, table_id, sub_task, questions, golden VARIANT) and ``meta``
    (table_id, ord, struct_type, markdown, pre_context, post_context), with ``part`` if the Markdown
    of a long table comes in numbered parts.  A question
    without a first final answer is left out.
    """
    asked = questions.filter(F.col("sub_task") == sub_task).withColumn(
        "answer", F.try_variant_get("golden", f"$[0].{ANSWER_LIST}[0].{FINAL_ANSWER}[0]", "string")
    )
    flat = selection.latest_meta(meta).filter(~F.col("struct_type").isin(list(excluded)))
    parsed = with_computed(flat, "t", parse_table(F.coalesce("markdown", F.lit("")))).withColumns(
        {"columns": F.col("t.columns"), "rows": F.col("t.rows"), "n_rows": F.size("t.rows").cast("bigint")}
    )
    fitting = parsed.filter(
        (F.size("columns") > 0) & (F.col("n_rows") > 0) & selection.rows_between(F.col("n_rows"), min_rows, max_rows)
    ).withColumn("table_name", F.trim(F.array_join(F.concat("pre_context", "post_context"), "")))
    joined = spread_join(
        asked.filter(F.col("answer").isNotNull()),
        fitting.select("table_id", "struct_type", "table_name", "columns", "rows", "n_rows"),
        ["table_id"],
        ["sample_id"],
    )
    return joined.select(
        "sample_id", F.coalesce(F.get("questions", F.lit(0)), F.lit("")).alias("question"), "answer", "sub_task",
        "table_name", "struct_type", "columns", "rows", "n_rows",
    )


def multi_table_subsets(
    tables: DataFrame,
    group: str,
    short: tuple[int, int] = (1, selection.SHORT_MAX_ROWS),
    long_min: int = selection.LONG_MIN_ROWS,
    min_tables: int = 2,
    per_group: int | None = None,
    with_any_length: bool = False,
) -> DataFrame:
    """Samples with enough short, or enough long tables, as (subset, group, sample_id, ord); with ``per_group`` the first ones.

    ``group`` tells files apart, such as those of two-table and three-table samples.
    """
    groups = tables.select("sample_id", group).distinct()
    ranges = {"short": short, "long": (long_min, None)} | ({"any": (None, None)} if with_any_length else {})
    parts = []
    for name, (low, high) in ranges.items():
        kept = selection.samples_with_tables_in_range(tables, low, high, min_tables).join(groups, "sample_id")
        first = kept if per_group is None else selection.first_n(kept, group, per_group)
        parts.append(first.select(F.lit(name).alias("subset"), group, "sample_id", "ord"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
