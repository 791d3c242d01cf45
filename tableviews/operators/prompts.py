"""Rendered tables, the three question-answering views, and the other request texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tableviews.functions import wording
from tableviews.functions.cells import INTEGER_TEXT
from tableviews.functions.markdown import rule_line, table_head, table_line
from tableviews.functions.replies import strip
from tableviews.functions.text import column_lines, example_block, fill_prompt, token_estimate
from tableviews.operators.ordering import spread_join
from tableviews.operators.profile import column_types
from tableviews.operators.verbalize import text_parts
from tableviews.schema import ROWS_PER_PART, TABLE_KEY

# Fixed value: the mark of a prompt beyond the budget.
TOO_LONG = "prompt_too_long"
CHARS_PER_TOKEN = 4.0
PREVIEW_ROWS = 3


def render_tables(rows: DataFrame, tables: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Tables as Markdown, as (sample_id, table_pos, part, markdown).

    Part 0 starts with title, header and rule; a table without rows has only them.
    A long table goes on in further parts, to be read in order.
    """
    lines = rows.select(*TABLE_KEY, "row_pos", table_line(F.col("cells")).alias("line"))
    bodies = text_parts(lines, TABLE_KEY, "line", "\n", rows_per_part)
    heads = tables.select(
        *TABLE_KEY, F.lit(0).cast("bigint").alias("part"), table_head(F.col("table_name"), F.col("columns")).alias("head")
    )
    return bodies.join(heads, [*TABLE_KEY, "part"], "full").select(
        *TABLE_KEY, "part", F.concat_ws("\n", "head", "body").alias("markdown")
    )


def table_sizes_in_chars(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Length of each sample's rendered tables, summed without rendering them together."""
    body = rows.select(
        "sample_id", (F.length(table_line(F.col("cells"))) + 1).cast("bigint").alias("chars"), F.lit(0).alias("is_table")
    )
    # a table also takes the blank line that parts it from the next one
    head = tables.select(
        "sample_id",
        (F.length(table_head(F.col("table_name"), F.col("columns"))) + 2).cast("bigint").alias("chars"),
        F.lit(1).alias("is_table"),
    )
    return body.unionByName(head).groupBy("sample_id").agg(
        F.greatest(F.sum("chars") - 2, F.lit(0)).alias("table_chars"), F.sum("is_table").alias("n_tables")
    )


def qa_prompt(view: Column, tables_md: Column, texts: Column, question: Column) -> Column:
    """Prompt text of one view."""
    w = wording
    tables = F.concat(F.lit(w.QA_TABLES_MARK), tables_md, F.lit("\n\n"))
    extra = F.concat(F.lit(w.QA_EXTRA_MARK), texts, F.lit("\n\n"))
    text_only = F.concat(F.lit(w.QA_TEXT_MARK), texts, F.lit("\n\n"))
    asked = F.concat(F.lit(w.QA_QUESTION_MARK), question, F.lit("\n\n" + w.QA_ENDING))
    return (
        F.when(view == "semi-structured", F.concat(F.lit(w.QA_TABLE_INTRO), tables, extra, asked))
        .when(view == "structured", F.concat(F.lit(w.QA_TABLE_INTRO), tables, asked))
        .when(view == "unstructured", F.concat(F.lit(w.QA_TEXT_INTRO), text_only, asked))
    )


def qa_prompt_chars(view: Column, table_chars: Column, text_chars: Column, question: Column) -> Column:
    """Length of ``qa_prompt`` from the lengths of its pieces."""
    def frame(name: str) -> Column:
        return F.length(qa_prompt(F.lit(name), F.lit(""), F.lit(""), F.lit("")))

    return (
        F.when(view == "semi-structured", frame("semi-structured") + table_chars + text_chars)
        .when(view == "structured", frame("structured") + table_chars)
        .when(view == "unstructured", frame("unstructured") + text_chars)
        + F.length(question)
    ).cast("bigint")


def qa_views(
    samples: DataFrame,
    tables: DataFrame,
    rows: DataFrame,
    segments: DataFrame,
    views: list[str] | None = None,
    budget: int | None = None,
    chars_per_token: float = CHARS_PER_TOKEN,
) -> DataFrame:
    """One prompt per sample and view: (sample_id, view, n_tokens_est, prompt, error).

    ``segments`` is (sample_id, table_pos, part, text).  Every prompt is delivered whole.  With
    a ``budget`` in tokens, ``error`` marks the prompts beyond it.
    """
    views = views or wording.QA_VIEWS
    table_chars = table_sizes_in_chars(rows, tables)
    text_chars = segments.groupBy("sample_id").agg((F.sum(F.length("text") + 1) - 1).alias("text_chars"))
    sized = (
        samples.select("sample_id", "question")
        .join(table_chars, "sample_id", "left")
        .join(text_chars, "sample_id", "left")
        .na.fill(0, ["table_chars", "text_chars"])
    )
    asked = sized.withColumn("view", F.explode(F.array(*[F.lit(v) for v in views])))
    asked = asked.withColumn(
        "n_tokens_est",
        token_estimate(
            qa_prompt_chars(F.col("view"), F.col("table_chars"), F.col("text_chars"), F.col("question")), chars_per_token
        ),
    )
    rendered = render_tables(rows, tables)
    ordered_tables = F.array_sort(F.collect_list(F.struct("table_pos", "part", "markdown")))
    # parts of one table go on line by line, tables are parted by a blank line
    glued = F.transform(ordered_tables, lambda t: F.concat(F.when(t["part"] > 0, "\n").otherwise("\n\n"), t["markdown"]))
    by_sample = rendered.groupBy("sample_id").agg(F.substring(F.array_join(glued, ""), 3, 2**31 - 1).alias("tables_md"))
    ordered_texts = F.array_sort(F.collect_list(F.struct("table_pos", "part", "text")))
    texts = segments.groupBy("sample_id").agg(
        F.array_join(F.transform(ordered_texts, lambda t: t["text"]), " ").alias("texts")
    )
    whole = asked.join(by_sample, "sample_id", "left").join(texts, "sample_id", "left")
    prompt = qa_prompt(
        F.col("view"), F.coalesce("tables_md", F.lit("")), F.coalesce("texts", F.lit("")), F.col("question")
    )
    beyond = F.lit(False) if budget is None else F.col("n_tokens_est") > budget
    return whole.select("sample_id", "view", "n_tokens_est", prompt.alias("prompt"), F.when(beyond, TOO_LONG).alias("error"))


def skipped_prediction(n_tokens: Column) -> Column:
    """Prediction text of a prompt beyond the budget."""
    return F.concat(F.lit("SKIPPED: prompt too long ("), n_tokens.cast("string"), F.lit(" tokens)"))


def column_requests(
    profile: DataFrame, columns: Column, template: Column | None = None, rules: dict[str, str] | None = None
) -> DataFrame:
    """Prompts asking for column labels and combinations; one per table and rule.

    ``profile`` holds db, table_name and column_examples.  With a ``template`` of the
    user's only its text is filled; otherwise one prompt per combination rule is made.
    """
    chosen = profile.withColumn("__cols", columns).filter(F.size("__cols") > 0)
    listed = column_lines(F.col("__cols"), F.col("column_examples"))
    values = {"db": F.col("db"), "table": F.col("table_name"), "cols": listed}
    if template is not None:
        return chosen.select("db", "table_name", F.lit("custom").alias("variant"), fill_prompt(template, values).alias("prompt"))
    rules = rules or wording.COMBINATION_RULES
    entries = F.explode(F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])).alias("variant", "rule")
    varied = chosen.select("*", entries)
    return varied.select(
        "db", "table_name", "variant",
        fill_prompt(F.lit(wording.COLUMN_REQUEST), values | {"rule": F.col("rule")}).alias("prompt"),
    )


def template_requests(combinations: DataFrame, examples: DataFrame, template: Column | None = None) -> DataFrame:
    """Prompts asking for row templates; ``examples`` is (db, table_name, column_examples)."""
    joined = spread_join(combinations, examples, ["db", "table_name"], ["columns"], "left")
    none = F.create_map().cast("map<string,array<string>>")
    shown_examples = example_block(F.col("columns"), F.coalesce("column_examples", none))
    values = {
        "db": F.col("db"),
        "table": F.col("table_name"),
        "sel_cols": F.array_join("columns", ", "),
        "example_block": shown_examples,
    }
    text = F.lit(wording.TEMPLATE_REQUEST) if template is None else template
    return joined.withColumn("prompt", fill_prompt(text, values))


def enrichment_prompt(row: Column, description: Column) -> Column:
    return fill_prompt(F.lit(wording.ENRICHMENT_REQUEST), {"row": row, "description": description})


def schema_previews(rows: DataFrame, tables: DataFrame, cells: DataFrame, preview_rows: int = PREVIEW_ROWS) -> DataFrame:
    """Per sample its tables with typed headers and the first rows, as (sample_id, schema_md)."""
    typed = column_types(cells, [*TABLE_KEY, "col_pos"]).groupBy(*TABLE_KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("col_pos", "sql_type"))).alias("types")
    )
    headed = tables.join(typed, TABLE_KEY, "left").withColumn(
        "types", F.transform("columns", lambda _, i: F.coalesce(F.element_at("types", i), F.lit("TEXT")))
    )
    first = rows.filter(F.col("row_pos") < preview_rows).join(headed.select(*TABLE_KEY, "columns", "types"), TABLE_KEY)
    as_real = lambda v, t: F.when((t == "REAL") & v.rlike(INTEGER_TEXT), F.concat(v, F.lit(".0"))).otherwise(v)
    padded = F.transform("types", lambda t, i: as_real(F.get("cells", i), t))
    bodies = text_parts(first.withColumn("line", table_line(padded)), TABLE_KEY, "line", "\n")
    named = F.zip_with("columns", "types", lambda c, t: F.concat(c, F.lit(" ("), t, F.lit(")")))
    blocks = headed.join(bodies.drop("part"), TABLE_KEY, "left").select(
        *TABLE_KEY,
        F.concat_ws(
            "\n",
            F.concat(F.lit("Table "), F.col("table_name")),
            F.when(F.size("columns") == 0, F.lit(wording.NO_COLUMNS)).otherwise(
                F.concat(table_line(named), F.lit("\n"), rule_line(F.size("columns")), F.lit("\n"), F.coalesce("body", F.lit("")))
            ),
        ).alias("block"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("table_pos", "block")))
    return blocks.groupBy("sample_id").agg(F.array_join(F.transform(ordered, lambda b: b["block"]), "\n").alias("schema_md"))


def sql_messages(schema_md: Column, question: Column, today: str, dialect: str = "SQLite") -> Column:
    """System and user message of a text-to-SQL request."""
    said = {"dialect": F.lit(dialect)}
    user = said | {"schema_md": F.coalesce(schema_md, F.lit(wording.NO_TABLES)), "question": question, "today": F.lit(today)}
    return F.array(
        _message("system", fill_prompt(F.lit(wording.SQL_SYSTEM), said)),
        _message("user", fill_prompt(F.lit(wording.SQL_USER), user)),
    )


def repair_messages(messages: Column, sql: Column, error: Column, dialect: str = "SQLite") -> Column:
    """The earlier messages, the failed statement, and its error."""
    fenced = F.concat(F.lit("```sql\n"), strip(sql), F.lit("\n```"))
    asked = fill_prompt(F.lit(wording.SQL_REPAIR), {"dialect": F.lit(dialect), "error": error})
    return F.concat(messages, F.array(_message("assistant", fenced), _message("user", asked)))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def judge_prompt(prediction: Column, truth: Column) -> Column:
    return fill_prompt(F.lit(wording.JUDGE), {"prediction": prediction, "truth": truth})
