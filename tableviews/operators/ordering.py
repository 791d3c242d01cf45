"""Ranks, running totals and joins that hold up when one key has most of the rows.

A window partitioned by such a key would sort all its rows in one task.  Here the
rows of a key are first cut into splits whose order is known; per-split sums are
small and are accumulated per key, and the fine order is only made inside a split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tableviews.schema import ROWS_PER_SLICE

# Parts of a group that are cut before the group itself.
SALTS = 256


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    split_by: Sequence[Column],
    measures: Mapping[str, Column],
) -> DataFrame:
    """Add ``<m>_run`` (sum up to and including the row) and ``<m>_all`` (sum of the key).

    ``split_by`` must agree with ``order``: rows of a lower split come first.  The
    rows are shuffled once, on key and split; only sums per split go through the
    window over the whole key.  Keys must not be NULL.
    """
    splits = [f"__split{i}" for i in range(len(split_by))]
    parts = [*keys, *splits]
    staged = df.withColumns(dict(zip(splits, split_by)) | {f"__m_{m}": c for m, c in measures.items()})

    sums = staged.groupBy(*parts).agg(*[F.sum(f"__m_{m}").alias(f"__s_{m}") for m in measures])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(*splits).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *parts,
        *[F.coalesce(F.sum(f"__s_{m}").over(earlier), F.lit(0)).alias(f"__b_{m}") for m in measures],
        *[F.sum(f"__s_{m}").over(whole).alias(f"{m}_all") for m in measures],
    )
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = staged.join(offsets, parts)
    totals = {f"{m}_run": F.col(f"__b_{m}") + F.sum(f"__m_{m}").over(inside) for m in measures}
    return joined.withColumns(totals).drop(*splits, *[f"__m_{m}" for m in measures], *[f"__b_{m}" for m in measures])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], split_by: Sequence[Column]
) -> DataFrame:
    """Give the rows of each key their dense position ``row_pos`` and the count ``n_rows``."""
    ranked = running_totals(df, keys, order, split_by, {"__n": F.lit(1).cast("bigint")})
    return ranked.withColumns({"row_pos": F.col("__n_run") - 1, "n_rows": F.col("__n_all")}).drop("__n_run", "__n_all")


def hash_digit(h: Column) -> Column:
    """The leading 16 bits of a 32-bit hash."""
    return F.shiftright(h, 16).cast("int")


def fraction_bounds(df: DataFrame, keys: Sequence[str], ratio: float, h: Column, tie: str) -> DataFrame:
    """Per key the last row of its first ``floor(n * ratio)`` rows in hash order, as (keys, last_h, last_tie).

    Rows up to this one are the exact fraction, so the rows themselves need no rank and can be marked where they are.
    Keys of which the fraction is no row, or all rows, have no bound.

    The bound is selected by counts: rows are counted by the leading 16 bits of their hash, which is done inside the
    tasks first, and the counts of a key, 65,536 at most, tell in which bucket the bound lies and how many rows of the
    bucket come before it.  A bucket of one row is settled then; of the others only the rows of the one bucket, the
    65,536th part of a key's rows, are looked at once more and gathered.  No rows are ranked.
    """
    narrow = df.select(*keys, F.col(tie).alias("__tie"), h.alias("__h")).withColumn("__digit", hash_digit(F.col("__h")))
    counts = narrow.groupBy(*keys, "__digit").agg(F.count("*").alias("__n"), F.min("__h").alias("__first_h"), F.min("__tie").alias("__first_tie"))
    by_digit = Window.partitionBy(*keys).orderBy("__digit")
    placed = counts.withColumns(
        {
            "__upto": F.sum("__n").over(by_digit.rowsBetween(Window.unboundedPreceding, 0)),
            "__all": F.sum("__n").over(by_digit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    ).withColumn("__goal", F.floor(F.col("__all") * F.lit(ratio)))
    nth = (F.col("__goal") - F.col("__upto") + F.col("__n")).cast("int")
    holding = placed.filter("1 <= __goal AND __goal < __all AND __upto - __n < __goal AND __goal <= __upto").withColumn("__nth", nth)
    single = holding.filter("__n = 1").select(*keys, F.col("__first_h").alias("last_h"), F.col("__first_tie").alias("last_tie"))
    bucket = narrow.join(holding.filter("__n > 1").select(*keys, "__digit", "__nth"), [*keys, "__digit"])
    gathered = bucket.groupBy(*keys, "__nth").agg(F.array_sort(F.collect_list(F.struct("__h", "__tie"))).alias("__rows"))
    several = gathered.select(*keys, F.element_at("__rows", F.col("__nth")).alias("r")).select(*keys, F.col("r.__h").alias("last_h"), F.col("r.__tie").alias("last_tie"))
    return single.unionByName(several)


def within_bound(h: Column, tie: Column) -> Column:
    """Whether a row belongs to the fraction of its key, once the bound is joined."""
    inside = (h < F.col("last_h")) | ((h == F.col("last_h")) & (tie <= F.col("last_tie")))
    return F.coalesce(inside, F.lit(False))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, salt_by: Sequence[str] | None = None
) -> DataFrame:
    """First k rows of every group.  ``order`` must be total for the result to be repeatable.

    The first cut runs per group and salt, so that one large group is no single task;
    what it leaves of a group is at most k rows for each salt.
    """
    salt_by = salt_by or [o for o in order if isinstance(o, str)]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)))
    cut = _first_rows(salted, [*keys, "__salt"], order, k).drop("__salt")
    return _first_rows(cut, keys, order, k)


def _first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rank") <= k).drop("__rank")


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = 1,
) -> DataFrame:
    """Equi-join for a left side whose keys repeat without bound.

    With one salt this is a plain join: adaptive execution splits the skewed partitions
    of the left side at run time.  With more, the left side is salted by ``spread_by`` and the
    right side, which has to be small, is copied to every salt; neither side is read twice.
    """
    if salts <= 1:
        return left.join(right, list(on), how)
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
