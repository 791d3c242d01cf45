"""Answers from SQL texts: lookups and aggregates over all tables at once, or texts one by one."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tableviews.functions.binding import bind, with_computed
from tableviews.functions.cells import INTEGER_TEXT, NAN_TEXT, number_of
from tableviews.functions.sqltext import (
    aggregate_spec, is_distinct, limit_of, lookup_parts, one_line, sql_tables,
)
from tableviews.functions.replies import guard_sql
from tableviews.operators.reshape import cells_at, with_tables
from tableviews.schema import ROWS_PER_PART, TABLE_KEY, row_slice
from tableviews.session import stored

# A text whose result has an order.
ORDERED_RESULT = re.compile(r"(?is)\border\s+by\b")

GROUP_SALTS = 1024

# Numbers whose sum is exact as a decimal.
PLAIN_DECIMAL = r"^\s*[+-]?\d{1,18}(\.\d{1,8})?\s*$"


def _lower_all(xs: Column) -> Column:
    return F.transform(xs, lambda x: F.lower(x))


def _position(columns: Column, name: Column) -> Column:
    """Zero-based position of a name without case; -1 where it is unknown."""
    return F.array_position(_lower_all(columns), F.lower(name)).cast("int") - 1


def _same(value: Column, literal: Column) -> Column:
    """Equal as numbers when both read as numbers, otherwise as text."""
    return F.coalesce(number_of(value) == number_of(literal), value == literal)


def _not_below(value: Column, literal: Column) -> Column:
    return F.coalesce(number_of(value) >= number_of(literal), value >= literal)


def predicate_holds(value: Column, pred: Column, ignore_case: bool = False) -> Column:
    """Whether one cell fulfils one predicate; a missing cell never does."""
    arg = F.get(pred["args"], F.lit(0))
    if ignore_case:
        like = F.like(F.lower(value), F.lower(arg))
    else:
        like = F.like(value, arg)
    between = _not_below(value, arg) & _not_below(F.get(pred["args"], F.lit(1)), value)
    test = (
        F.when(pred["op"] == "=", _same(value, arg))
        .when(pred["op"] == "like", like)
        .when(pred["op"] == "between", between)
        .when(pred["op"] == "in", F.exists(pred["args"], lambda a: _same(value, a)))
    )
    return F.coalesce(test, F.lit(False))


def _located(preds: Column, columns: Column) -> Column:
    """Predicates with the position of their column."""
    return F.transform(preds, lambda p: F.struct(_position(columns, p["col"]).alias("at"), p["op"].alias("op"), p["args"].alias("args")))


def _known(preds: Column) -> Column:
    return F.forall(preds, lambda p: p["at"] >= 0)


def _of_tables(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Queries with the header of the table they name; equal names: the later table counts."""
    named = tables.groupBy("sample_id", F.lower("table_name").alias("__table")).agg(
        F.max_by(F.struct("table_pos", "columns", "n_rows"), "table_pos").alias("t")
    )
    wanted = queries.withColumn("__table", F.lower(F.get(sql_tables(F.col("sql")), F.lit(0))))
    return wanted.join(named, ["sample_id", "__table"]).select(*queries.columns, "t.*")


def _lookup_of(sql: Column) -> Column:
    """The lookup that a text is, or NULL."""
    def spec_of(q: Column) -> Column:
        found = lambda p: F.when(
            p.isNotNull(), F.struct(p["preds"].alias("preds"), p["names"].alias("names"), is_distinct(q).alias("dedupe"), limit_of(q).alias("row_limit"))
        )
        return bind(lookup_parts(q), found)

    return bind(F.rtrim(one_line(sql), F.lit("; ")), spec_of)


def _resolved_lookups(found: DataFrame) -> DataFrame:
    """Lookups in ``lookup``, resolved against the header beside them."""
    listed = found.filter(F.col("lookup").isNotNull()).select("sample_id", "table_pos", "columns", "n_rows", "lookup.*")
    every = F.transform("columns", lambda _, i: i)
    shown_at = F.flatten(
        F.transform("names", lambda n: F.when(n == "*", every).otherwise(F.array(_position(F.col("columns"), n))))
    )
    resolved = listed.withColumns({"preds": _located(F.col("preds"), F.col("columns")), "shown_at": shown_at})
    return resolved.filter(_known(F.col("preds")) & F.forall("shown_at", lambda p: p >= 0))


def lookup_specs(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Lookups among (sample_id, sql), resolved against their table."""
    lookups = with_computed(queries.select("sample_id", "sql"), "lookup", _lookup_of(F.col("sql"))).filter(F.col("lookup").isNotNull())
    return _resolved_lookups(_of_tables(lookups, tables))


def answer_lookups(queries: DataFrame, tables: DataFrame, rows: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Answers of all lookups in one job, as (sample_id, row_pos, answer ARRAY<STRING>).

    A row carries all its cells, so all predicates of a query are tested on the row
    itself: one join, no counting of hits.  Long tables are spread by slice, and
    DISTINCT and LIMIT first work inside a slice.
    """
    met = _met(rows, lookup_specs(queries, tables), LOOKUP_FIELDS, ignore_case)
    # read by the parts below, so computed once
    return _lookups_from(stored(met.select("sample_id", "row_pos", "dedupe", "row_limit", _shown())))


LOOKUP_FIELDS = ["preds", "shown_at", "dedupe", "row_limit"]


def _met(rows: DataFrame, specs: DataFrame, fields: list[str], ignore_case: bool) -> DataFrame:
    """Rows with the texts whose predicates they fulfil."""
    return with_tables(rows, specs, *fields).filter(
        F.forall("preds", lambda p: predicate_holds(F.get("cells", p["at"]), p, ignore_case))
    )


def _shown() -> Column:
    return cells_at(F.col("shown_at"), F.col("cells")).alias("answer")


def _lookups_from(hits: DataFrame) -> DataFrame:
    # only DISTINCT texts need their rows together
    once = hits.filter(~F.col("dedupe")).select("sample_id", "answer", "row_limit", "row_pos").unionByName(
        hits.filter("dedupe").groupBy("sample_id", "answer", "row_limit").agg(F.min("row_pos").alias("row_pos"))
    )
    return _limit_rows(once, [F.col("row_pos")], row_slice()).select("sample_id", "row_pos", "answer")


def _limit_rows(df: DataFrame, order: list[Column], salt: Column) -> DataFrame:
    """Keep ``row_limit`` rows per sample where it is set: first per salt, then per sample.  Rows without a limit are not ranked."""
    unlimited = F.col("row_limit").isNull()
    whole = df.filter(unlimited)
    salted = df.filter(~unlimited).withColumn("__salt", salt)
    near = F.row_number().over(Window.partitionBy("sample_id", "__salt").orderBy(*order))
    cut = salted.withColumn("__r", near).filter(F.col("__r") <= F.col("row_limit"))
    far = F.row_number().over(Window.partitionBy("sample_id").orderBy(*order))
    limited = cut.withColumn("__r", far).filter(F.col("__r") <= F.col("row_limit")).drop("__r", "__salt")
    return whole.unionByName(limited)


def _resolved_aggregates(found: DataFrame) -> DataFrame:
    """Aggregates in ``aggregate``, resolved against the header beside them."""
    at = lambda name: _position(F.col("columns"), name)
    spec = lambda name: F.col(f"aggregate.{name}")
    resolved = found.filter(F.col("aggregate").isNotNull()).select(
        *TABLE_KEY, "n_rows", spec("func"), spec("shows"), spec("order_by"), spec("descending"), spec("row_limit"),
        F.when(spec("target") == "*", F.lit(-2)).otherwise(at(spec("target"))).alias("target_at"),
        F.when(spec("group_col").isNotNull(), at(spec("group_col"))).alias("group_at"),
        _located(spec("preds"), F.col("columns")).alias("preds"),
    )
    known = (F.col("target_at") != -1) & F.coalesce(F.col("group_at") >= 0, F.lit(True)) & _known(F.col("preds"))
    return resolved.filter(known)


def aggregate_specs(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """Single-table aggregates among (sample_id, sql), resolved against their table."""
    parsed = with_computed(queries.select("sample_id", "sql"), "aggregate", aggregate_spec(F.col("sql"))).filter("aggregate IS NOT NULL")
    return _resolved_aggregates(_of_tables(parsed, tables))


class Specs(NamedTuple):
    """The lookups and the aggregates among some texts."""

    lookups: DataFrame
    aggregates: DataFrame


def specs_of(queries: DataFrame, tables: DataFrame) -> Specs:
    """``lookup_specs`` and ``aggregate_specs`` at once: texts are parsed once, meet their table once and are stored."""
    parsed = with_computed(queries.select("sample_id", "sql"), "lookup", _lookup_of(F.col("sql")))
    parsed = with_computed(parsed, "aggregate", aggregate_spec(F.col("sql"))).filter("lookup IS NOT NULL OR aggregate IS NOT NULL")
    found = stored(_of_tables(parsed, tables).drop("sql"))
    return Specs(_resolved_lookups(found), _resolved_aggregates(found))


AGGREGATE_FIELDS = ["func", "shows", "order_by", "descending", "row_limit", "target_at", "group_at", "preds"]
PER_QUERY = ["sample_id", "func", "shows", "order_by", "descending", "row_limit"]


def _described() -> list[Column]:
    """What an aggregate needs of a row."""
    cell = F.when(F.col("target_at") >= 0, F.get("cells", F.col("target_at")))
    return [
        F.get("cells", F.col("group_at")).alias("group_value"),
        F.col("group_at").isNotNull().alias("grouped"),
        (F.col("target_at") == -2).alias("counts_rows"),
        cell.alias("cell"),
        number_of(cell).alias("number"),
    ]


def answer_aggregates(queries: DataFrame, tables: DataFrame, rows: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Answers of all single-table aggregates in one job.

    Result: (sample_id, group_value, value DOUBLE, answer ARRAY<STRING>).  Sums and
    extremes are combined inside the tasks; a limit is cut per salt of the group
    value first, so a table with very many groups is not ranked in one task.
    """
    # a row for each text, read by the rows and again for texts that no row answers
    specs = stored(aggregate_specs(queries, tables))
    # read by the parts below, so computed once
    described = stored(_met(rows, specs, AGGREGATE_FIELDS, ignore_case).select(*PER_QUERY, *_described()))
    return _aggregates_from(described, specs)


def _aggregates_from(described: DataFrame, specs: DataFrame) -> DataFrame:
    plain = F.col("cell").rlike(PLAIN_DECIMAL)
    counted = [
        F.count_if(F.col("counts_rows") | F.col("cell").isNotNull()).alias("n"),
        F.sum("number").alias("total"),
        F.sum(F.when(plain, F.col("cell").try_cast("decimal(28,8)"))).alias("exact"),
        F.bool_and(F.col("number").isNull() | plain).alias("plain"),
        F.avg("number").alias("mean"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.bool_and(F.col("cell").isNull() | F.col("cell").rlike(INTEGER_TEXT)).alias("whole"),
    ]
    words = F.when(F.col("number").isNull(), F.col("cell"))
    none = F.lit(None).cast("string")
    by = [*PER_QUERY, "grouped", "group_value"]
    # extremes of text make Spark sort its rows, so only texts that ask for extremes compute them
    extreme = F.col("func").isin("min", "max")
    summed = described.filter(~extreme).groupBy(*by).agg(*counted).withColumns({"low_text": none, "high_text": none}).unionByName(
        described.filter(extreme).groupBy(*by).agg(*counted, F.min(words).alias("low_text"), F.max(words).alias("high_text"))
    )
    func = F.col("func")
    value = (
        F.when(func == "count", F.col("n").cast("double"))
        .when(func == "sum", F.when(F.col("plain"), F.col("exact").cast("double")).otherwise(F.col("total")))
        .when(func == "avg", F.col("mean"))
        .when(func == "min", F.col("low"))
        .when(func == "max", F.col("high"))
    )
    as_text = F.coalesce(
        F.when(func == "count", F.col("n").cast("string"))
        .when((func == "sum") & F.col("plain") & F.col("whole"), F.col("exact").cast("decimal(38,0)").cast("string"))
        .when((func != "avg") & F.col("whole"), value.cast("decimal(38,0)").cast("string"))
        .otherwise(value.cast("string")),
        F.when(func == "min", F.col("low_text")).when(func == "max", F.col("high_text")),
    )
    valued = summed.withColumns({"value": value, "value_text": as_text})
    down = F.col("descending")
    by_value, by_group = F.col("order_by") == "value", F.col("order_by") == "group"
    order = [
        F.when(by_value & down, F.col("value")).desc_nulls_last(),
        F.when(by_value & ~down, F.col("value")).asc_nulls_last(),
        F.when(by_group & down, F.col("group_value")).desc_nulls_last(),
        F.col("group_value").asc_nulls_last(),
    ]
    cut = _limit_rows(valued, order, F.pmod(F.xxhash64("group_value"), F.lit(GROUP_SALTS)))
    # an aggregate without GROUP BY answers even when no row is left
    ungrouped = specs.filter(F.col("group_at").isNull()).select("sample_id", "func", "shows")
    silent = ungrouped.join(cut.select("sample_id"), "sample_id", "left_anti").select(
        "sample_id",
        "shows",
        F.lit(None).cast("string").alias("group_value"),
        F.when(func == "count", 0.0).alias("value"),
        F.when(func == "count", "0").alias("value_text"),
    )
    rows_out = cut.select("sample_id", "shows", "group_value", "value", "value_text").unionByName(silent)
    answer = (
        F.when(F.col("shows") == "group", F.array("group_value"))
        .when(F.col("shows") == "both", F.array("group_value", "value_text"))
        .otherwise(F.array("value_text"))
    )
    return rows_out.select("sample_id", "group_value", "value", answer.alias("answer"))


# What became of a sample's text.
ANSWERED, EMPTY, UNSUPPORTED = "answered", "empty", "not supported"


def recompute_answers(queries: DataFrame, tables: DataFrame, rows: DataFrame, specs: Specs | None = None) -> DataFrame:
    """Answers of all lookups and aggregates on the given table version, as (sample_id, row_pos, answer).

    Rows meet lookups and aggregates in one join.  ``specs`` are those of the queries, if the caller has them.
    """
    lookups, aggregates = specs or specs_of(queries, tables)
    both = lookups.select(*TABLE_KEY, "n_rows", *LOOKUP_FIELDS).unionByName(aggregates, allowMissingColumns=True)
    fields = list(dict.fromkeys([*LOOKUP_FIELDS, *AGGREGATE_FIELDS]))
    # read by the parts below, so computed once
    hits = stored(_met(rows, both, fields, False).select(*PER_QUERY, "row_pos", "dedupe", _shown(), *_described()))
    found = _aggregates_from(hits.filter("func IS NOT NULL"), aggregates)
    return _lookups_from(hits.filter("func IS NULL").select("sample_id", "row_pos", "dedupe", "row_limit", "answer")).unionByName(
        found.select("sample_id", F.lit(0).cast("bigint").alias("row_pos"), "answer")
    )


def answer_status(queries: DataFrame, tables: DataFrame, answers: DataFrame, specs: Specs | None = None) -> DataFrame:
    """One row per sample: (sample_id, status, n_answer_rows).

    A text that is neither a lookup nor an aggregate, or names what its tables lack, is not
    supported here; Spark's own engine answers it over registered views (``run_workload``).
    ``specs`` are those of the queries, if the caller has them.
    """
    lookups, aggregates = specs or specs_of(queries, tables)
    known = lookups.select("sample_id").unionByName(aggregates.select("sample_id")).distinct()
    counted = answers.groupBy("sample_id").agg(F.count("*").alias("n"))
    joined = queries.select("sample_id").join(counted, "sample_id", "left").join(known.withColumn("known", F.lit(True)), "sample_id", "left")
    status = F.when(F.col("n") > 0, ANSWERED).when(F.col("known"), EMPTY).otherwise(UNSUPPORTED)
    return joined.select("sample_id", status.alias("status"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_answer_rows"))


def answer_quality(answers: DataFrame) -> DataFrame:
    """Per sample whether its answer is complete (``ok``) and says something (``meaningful``).

    Both are sums over the answer rows, so no answer has to be gathered for it.
    """
    count_of = lambda test: F.size(F.filter("answer", test))
    says = lambda x: x.isNotNull() & (x != "") & (x != NAN_TEXT)
    sized = answers.select(
        "sample_id",
        F.size("answer").alias("n"),
        count_of(lambda x: x.isNull() | (x == NAN_TEXT)).alias("n_missing"),
        count_of(says).alias("n_saying"),
        count_of(lambda x: F.coalesce(number_of(x) == 0, F.lit(False))).alias("n_zero"),
    )
    summed = sized.groupBy("sample_id").agg(*[F.sum(c).alias(c) for c in ("n", "n_missing", "n_saying", "n_zero")])
    only_zero = (F.col("n") == 1) & (F.col("n_zero") == 1)
    return summed.select(
        "sample_id",
        F.col("n").alias("n_values"),
        ((F.col("n") > 0) & (F.col("n_missing") == 0)).alias("ok"),
        ((F.col("n_saying") > 0) & ~only_zero).alias("meaningful"),
    )


def answer_parts(answers: DataFrame, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Answer rows as nested lists, as (sample_id, part, answer); short answers have part 0 only."""
    part = F.floor(F.col("row_pos") / F.lit(rows_per_part)).cast("bigint")
    ordered = F.array_sort(F.collect_list(F.struct("row_pos", "answer")))
    return answers.withColumn("part", part).groupBy("sample_id", "part").agg(
        F.transform(ordered, lambda r: r["answer"]).alias("answer")
    )


WORKLOAD_DDL = "query_id string, row_pos long, columns array<string>, row_json string, error string"


def run_workload(spark: SparkSession, queries: Sequence[tuple[str, str]], folder: str | None = None) -> DataFrame:
    """Run a short list of SQL texts over registered views.

    Result: (query_id, row_pos, columns, row_json, error).  Only SELECT texts run.  Each text is
    planned and written on its own, below ``folder`` or the shared folder, so one that cannot be
    planned or fails while it runs gives one row with its error and harms no other.  ``row_json``
    is an object by column number, so missing values and equal names stay; ``row_pos`` counts the
    rows of a text that orders its result and is NULL for others.  Meant for tens or hundreds of
    texts over large tables.
    """
    out = spark.createDataFrame([], WORKLOAD_DDL)
    for query_id, text in queries:
        out = out.unionByName(_run_text(spark, query_id, text, folder))
    return out


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with ``row_pos`` from the ids that the tasks of one write gave.

    An id holds its task's number above 33 bits that count the task's rows, and tasks follow the order of the result; so
    a row's place is its count and the rows of the tasks before, and only one row for each task is put in order.
    """
    task = F.shiftright("place", 33)
    sizes = rows.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("task", task).join(sizes.select("task", before.alias("before")), "task").withColumn("row_pos", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))


def _run_text(spark: SparkSession, query_id: str, text: str, folder: str | None) -> DataFrame:
    failed = lambda error: spark.createDataFrame([(query_id, None, [], None, error)], WORKLOAD_DDL)
    guarded = spark.range(1).select(guard_sql(F.lit(text)).alias("g")).select("g.*").first()
    if guarded.error is not None:
        return failed(guarded.error)
    try:
        result = spark.sql(guarded.sql.rstrip("; "))
        names = result.columns
        numbered = result.toDF(*[str(i) for i in range(len(names))])
        ordered = bool(ORDERED_RESULT.search(text))
        place = F.monotonically_increasing_id() if ordered else F.lit(None).cast("bigint")
        rows = numbered.select(place.alias("place"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in numbered.columns]), {"ignoreNullFields": "false"}).alias("row_json"))
        rows = stored(rows, folder)
    except (PySparkException, Py4JJavaError) as exc:
        return failed((exc.getCondition() if isinstance(exc, PySparkException) else None) or type(exc).__name__)
    placed = _in_order(rows) if ordered else rows.withColumn("row_pos", F.lit(None).cast("bigint"))
    return placed.select(
        F.lit(query_id).alias("query_id"),
        "row_pos",
        F.array(*[F.lit(c) for c in names]).cast("array<string>").alias("columns"),
        "row_json",
        F.lit(None).cast("string").alias("error"),
    )
