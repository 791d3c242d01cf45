"""Operators on data where one key has most rows, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tableviews.functions.hashing import stable_hash
from tableviews.operators import ordering, selection, verbalize


@pytest.fixture(scope="module")
def skewed(spark):
    """(k, v, w): key 0 has two thirds of 6,000 rows."""
    rnd = random.Random(5)
    data = [(0 if i % 3 else rnd.randrange(1, 60), i, rnd.randrange(100)) for i in range(6000)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "k long, v long, w long")


def test_running_totals(skewed):
    data, df = skewed
    out = ordering.running_totals(df, ["k"], ["v"], [F.floor(F.col("v") / 97)], {"n": F.lit(1), "w": F.col("w")})
    got = {(r.k, r.v): (r.n_run, r.n_all, r.w_run, r.w_all) for r in out.collect()}
    groups = defaultdict(list)
    for k, v, w in sorted(data, key=lambda r: r[1]):
        groups[k].append((v, w))
    assert len(got) == len(data)
    for k, rows in groups.items():
        total, run = sum(w for _, w in rows), 0
        for i, (v, w) in enumerate(rows):
            run += w
            assert got[(k, v)] == (i + 1, len(rows), run, total)


def test_number_rows_is_dense(skewed):
    data, df = skewed
    out = ordering.number_rows(df, ["k"], ["v"], [F.floor(F.col("v") / 500)])
    positions = defaultdict(set)
    for r in out.collect():
        positions[(r.k, r.n_rows)].add(r.row_pos)
    for (_, n), seen in positions.items():
        assert seen == set(range(n))


def _taken(df, ratio):
    """Rows with ``taken``; df is (k, v, n)."""
    h = stable_hash(1, "k", "v")
    bounds = ordering.fraction_bounds(df, ["k"], ratio, h, "v")
    return df.join(bounds, "k", "left").withColumn("taken", ordering.within_bound(h, F.col("v")))


@pytest.mark.parametrize("ratio, bits", [(0.3, 16), (0.5, 16), (0.3, 4), (0.5, 4), (0.5, 0)])
def test_fraction_is_exact(skewed, ratio, bits, monkeypatch):
    data, df = skewed
    # few leading bits, so that the buckets of the bounds hold many rows
    monkeypatch.setattr(ordering, "hash_digit", lambda h: F.shiftright(h, 32 - bits).cast("int"))
    counts = df.groupBy("k").agg(F.count("*").alias("n"))
    out = _taken(df.join(counts, "k"), ratio)
    again = _taken(df.repartition(7).join(counts, "k"), ratio)
    taken = defaultdict(list)
    for r in out.collect():
        taken[r.k].append(r.taken)
    assert sum(len(rows) for rows in taken.values()) == len(data)
    for rows in taken.values():
        goal = int(len(rows) * ratio)
        assert sum(rows) == (goal if 1 <= goal < len(rows) else 0)
    assert {r.v for r in out.filter("taken").collect()} == {r.v for r in again.filter("taken").collect()}


@pytest.mark.parametrize("n,expected", [(1, 0), (2, 1), (3, 1), (10, 5)])
def test_fraction_of_short_tables(spark, n, expected):
    df = spark.range(n).select(F.lit("t").alias("k"), F.col("id").alias("v"), F.lit(n).alias("n"))
    out = _taken(df, 0.5)
    assert out.filter("taken").count() == expected and out.count() == n


@pytest.mark.parametrize("k", [3, 150])
def test_top_per_group(skewed, k):
    data, df = skewed
    got = {(r.k, r.v) for r in ordering.top_per_group(df, ["k"], ["w", "v"], k).collect()}
    groups = defaultdict(list)
    for key, v, w in data:
        groups[key].append((w, v))
    assert got == {(key, v) for key, rows in groups.items() for _, v in sorted(rows)[:k]}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join(spark, skewed, how):
    _, df = skewed
    right = spark.createDataFrame([(0, "a"), (0, "b"), (7, "c")], "k long, t string")
    plain = sorted((r.v, r.t or "") for r in df.join(right, "k", how).collect())
    spread = sorted((r.v, r.t or "") for r in ordering.spread_join(df, right, ["k"], ["v"], how, salts=16).collect())
    assert plain == spread


def test_long_table_through_slices(spark, monkeypatch):
    """A table cut into many slices and parts gives the same text as in one piece."""
    from tableviews import schema
    from tableviews.operators import reshape

    n = 1000
    rows = spark.range(n).select(
        F.lit("s").alias("sample_id"), F.lit(0).alias("table_pos"), F.col("id").alias("row_pos"), F.lit(n).cast("bigint").alias("n_rows"),
        F.array(F.col("id").cast("string"), F.lit("x")).alias("cells"),
    ).repartition(5)
    tables = spark.createDataFrame([("s", 0, n, ["a", "b"])], "sample_id string, table_pos int, n_rows long, columns array<string>")
    monkeypatch.setattr(reshape, "row_slice", lambda: schema.row_slice(64))
    monkeypatch.setattr(reshape, "table_slices", lambda: schema.table_slices(64))
    joined = reshape.with_tables(rows, tables, "columns").withColumn("description", F.element_at("cells", 1))
    assert joined.count() == n
    parts = {r.part: r.body for r in verbalize.paragraphs(joined, rows_per_part=100).collect()}
    assert sorted(parts) == list(range(10))
    assert " ".join(parts[i] for i in range(10)) == " ".join(str(i) for i in range(n))


def test_sample_per_type_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("sample_id"), F.lit("t").alias("sql_type"))
    a = {r.sample_id for r in selection.sample_per_type(df, 120).collect()}
    b = {r.sample_id for r in selection.sample_per_type(df.repartition(11), 120).collect()}
    assert a == b and len(a) == 120


def test_fractions_of_equal_hashes_go_by_the_tie(spark):
    df = spark.createDataFrame([(k, v) for k in range(5) for v in range(2 * k + 1)], "k long, v long")
    bounds = ordering.fraction_bounds(df, ["k"], 0.5, F.lit(7).cast("bigint"), "v")
    assert {r.k: (r.last_h, r.last_tie) for r in bounds.collect()} == {k: (7, k - 1) for k in range(1, 5)}


def test_no_rows_are_ranked_for_a_fraction(skewed):
    _, df = skewed
    plan = ordering.fraction_bounds(df, ["k"], 0.5, stable_hash(1, "k", "v"), "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "rank(" not in plan
    # what windows see are counts by bucket
    assert all("__n" in line for line in plan.splitlines() if "Window" in line)


@pytest.mark.parametrize("ratio", [0.0, 0.3, 0.5, 1.0])
def test_shares_of_short_and_long_tables(spark, ratio, monkeypatch):
    """A table of one slice is settled where its rows met their set; longer ones, and rows that come twice, give the same as bounds."""
    from tableviews import schema
    from tableviews.operators import reshape

    monkeypatch.setattr(reshape, "row_slice", lambda: schema.row_slice(16))
    monkeypatch.setattr(reshape, "table_slices", lambda: schema.table_slices(16))
    monkeypatch.setattr(verbalize, "ROWS_PER_SLICE", 16, raising=False)
    sizes = {"a": 5, "b": 1, "c": 40, "d": 16, "e": 17, "twice": 7}
    rows = spark.createDataFrame(
        [(s, 0, i, n, [str(i), None if i % 4 == 3 else "x"]) for s, n in sizes.items() for i in range(n)],
        "sample_id string, table_pos int, row_pos long, n_rows long, cells array<string>",
    ).repartition(5)
    chosen = spark.createDataFrame(
        [(s, 0, n, ["k", "v"], ["{k} is {v}."], [0, 1]) for s, n in [*sizes.items(), ("twice", 7)]],
        "sample_id string, table_pos int, n_rows long, set_columns array<string>, templates array<string>, set_positions array<int>",
    )
    split = verbalize.split_rows(rows, chosen, ratio)
    # however large the tables are, stored rows are not shuffled to their bounds
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = split.select("*")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin" in next(x for x in plan.splitlines() if "LeftOuter" in x)
    h = stable_hash(verbalize.SEED, "sample_id", "table_pos", "row_pos")
    complete = verbalize.complete_rows(rows, chosen)
    bounds = ordering.fraction_bounds(complete, schema.TABLE_KEY, ratio, h, "row_pos")
    marked = complete.join(bounds, schema.TABLE_KEY, "left").withColumn("taken", ordering.within_bound(h, F.col("row_pos")))
    told = F.when(F.col("taken"), F.concat(F.col("cells")[0], F.lit(" is x.")))
    expected = marked.select("sample_id", "row_pos", "taken", told.alias("description"))
    got = split.select("sample_id", "row_pos", "taken", "description")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert got.filter("taken").count() == 0 if ratio in (0.0, 1.0) else got.filter("sample_id = 'c' AND taken").count() == int(30 * ratio)
