"""Order-independent pseudo-random numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 1 << 32


def stable_hash(seed: int | str, *cols: Column | str) -> Column:
    """A number in [0, 2^32) that depends only on the seed and the values.

    It does not change with partitioning, task order or retries, and any engine
    with md5 can reproduce it.
    """
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")
