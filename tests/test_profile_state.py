"""Profiles merged from batches, and word usage by tokens, against the plain ones."""

import random

import pytest
from pyspark.sql import functions as F

from tableviews.operators import profile
from tableviews.plans import profile_state

NAMES = ["price", "Stock", "note, long", "größe", "a.b", "x_1", "order", "price", "stock"]


@pytest.fixture(scope="module")
def tables(spark):
    """Samples of few tables with several headers; names that repeat, hold blanks and other characters."""
    draw = random.Random(8)
    rows = []
    for k in range(240):
        columns = draw.sample(NAMES, draw.randrange(0, 6))
        if draw.random() < 0.1 and columns:
            columns.append(columns[0])
        sql = " ".join(draw.choice(["select", "PRICE", "stock,", "stocks", '"note, long"', "größe", "(a.b)", "x_1=2", "x_12", "order_by"]) for _ in range(5))
        rows.append((f"s{k}", k % 2, 1000 - k, draw.choice("ab"), draw.choice("tu"), sql.lower(), columns, k % 7, len(columns)))
    return spark.createDataFrame(rows, "sample_id string, table_pos int, ord long, db string, table_name string, sql string, columns array<string>, n_rows long, n_cols int")


def plain(df):
    return sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: (r.get("db") or "", r["table_name"], r.get("column") or ""))


@pytest.mark.parametrize("by_name", [False, True])
def test_words_by_tokens_are_those_found_by_pattern(tables, by_name):
    searched = profile.column_mentions(tables, True).groupBy(*profile._table_key(by_name), "column").agg(
        F.count("*").alias("total"), F.count_if("mentioned").alias("matched"), F.max_by("db", "ord").alias("last_db"), F.max("ord").alias("last_ord"),
        F.min(F.struct("ord", "table_pos")).alias("first_at"),
    )
    by_tokens = profile.column_stats(tables, word=True, by_name=by_name)
    assert plain(by_tokens.drop("first_seen")) == plain(searched)
    # the place where a column was first seen holds it
    at = {(r.sample_id, r.table_pos): r.columns for r in tables.collect()}
    assert all(at[r.first_seen.sample_id, r.first_seen.table_pos][r.first_seen.col_pos] == r.column for r in by_tokens.collect())


@pytest.mark.parametrize("by_name", [False, True])
def test_usage_is_counted_without_a_sort(tables, by_name):
    used = profile.column_usage(tables, by_name=by_name)
    plan = profile.column_counts(tables, by_name=by_name)._jdf.queryExecution().executedPlan().toString()
    # only the databases of a name are compared as texts, once each column of a table is one row
    inside = plan[plan.rindex("\n", 0, plan.index("partial_count")) :]
    assert "HashAggregate(" in inside and "Sort" not in inside
    assert used.count() == (2 if by_name else 4)


@pytest.mark.parametrize("by_name", [False, True])
def test_stats_are_those_of_one_aggregate(tables, by_name):
    rows = tables.union(tables.limit(5)).withColumn("db", F.when(F.col("ord") % 5 != 0, F.col("db")))
    keys = profile._table_key(by_name)
    whole = profile.column_mentions(rows).groupBy(*keys, "column").agg(
        F.count("*").alias("total"), F.count_if("mentioned").alias("matched"), F.max_by("db", "ord").alias("last_db"), F.max("ord").alias("last_ord"),
        F.min(F.struct("ord", "table_pos")).alias("first_at"),
    )
    stats = profile.column_stats(rows, by_name=by_name)
    assert plain(stats.drop("first_seen")) == plain(whole)
    at = {(r.sample_id, r.table_pos): r.columns for r in rows.collect()}
    assert all(at[r.first_seen.sample_id, r.first_seen.table_pos][r.first_seen.col_pos] == r.column for r in stats.collect())


def test_no_text_is_searched_for_simple_names(tables):
    simple = tables.withColumn("columns", F.array(F.lit("price"), F.lit("x_1")))
    plan = profile.column_stats(simple, word=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array_distinct(split(lower(sql" in plan


@pytest.mark.parametrize("word", [False, True])
def test_merged_batches_are_the_profile_of_all(spark, tables, tmp_path, word):
    folder = str(tmp_path / "state")
    kinds = tables.select("sample_id", F.when(F.contains("sql", F.lit("price")), "priced").otherwise("other").alias("kind"))
    for batch in (2, 0, 1, 0):
        own = tables.filter(F.col("ord") % 3 == batch)
        profile_state.add_batch(profile_state.state_of(own, kinds.join(own.select("sample_id"), "sample_id"), word), folder, str(batch))
    state = profile_state.merged(spark, folder)
    assert plain(state.columns.drop("first_seen")) == plain(profile.column_stats(tables, word).drop("first_seen"))
    assert plain(profile.usage_of(state.columns)) == plain(profile.column_usage(tables, word))
    assert plain(profile.high_freq_of(state.columns)) == plain(profile.high_freq_columns(tables, word))
    size, whole = profile_state.average_size(state).first(), profile.average_table_size(tables).first()
    assert size.avg_rows == pytest.approx(whole.avg_rows) and size.avg_cols == pytest.approx(whole.avg_cols)
    shares = {r.kind: (r["count"], r.share) for r in profile_state.kind_shares(state).collect()}
    assert shares == {r.kind: (r["count"], pytest.approx(r.share)) for r in profile.shares(kinds, "kind").collect()}
