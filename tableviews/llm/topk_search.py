"""Exact top-k inner-product search with an impact-ordered index, scored a level at a time.

The index holds, for each block of vectors and each dimension, the block's values in descending order with the
vectors they belong to (a posting list by impact). A query goes through the postings of all dimensions by
descending quantised impact |query value * posting value|: at each level it adds the postings between that
level's bound and the last one's to the vectors' scores. What a vector's other postings add is at most the product
of the lengths of what is left of the vector and of the query (Cauchy and Schwarz). A query stops as soon as the
vectors whose upper bound reaches the k-th best exact score of the leading ones are few, and these are scored exactly; when no level
proves it, all vectors are. Nothing else ends a search, so the result is exact.

Components become floor(256 * x). Vectors that are null, empty or hold null or non-finite components take no part,
nor do rows without id. Vectors of several lengths meet only vectors of their own length. Rows that repeat id and
vector count once; one id with two vectors gives two
candidates, and as a query one result, of the best for either. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableviews.llm.shared import column, stored

SCALE = 256
BLOCK_ROWS = 4096
QUERIES_PER_BATCH = 128
# Bounds of the impact levels as shares of a query's largest possible impact, and the share of a block that may be rescored.
LEVELS = (0.06, 0.03)
RESCORED = 0.1


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, values) with integer components; rows that take no part are left out."""
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    values = F.transform(x, lambda v: F.floor(v * SCALE).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("values")).distinct()


class ImpactBlock:
    """The posting lists of one block, and where each quantised value level begins in them."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, grid: int = 64):
        """ids in ascending order; values: one row for each vector."""
        self.ids, self.values = ids, values
        self.order = np.argsort(-values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        self.largest = np.abs(values).max(axis=0, initial=0)
        self.step = max(1.0, float(self.largest.max(initial=0)) / (grid - 1))
        self.grid = grid
        steps = self.step * np.arange(grid + 1)
        # postings of at least a level stand before head, those of at most minus the level from tail on
        self.head = np.array([np.searchsorted(-row, -steps, "right") for row in self.sorted])
        self.tail = np.array([np.searchsorted(-row, steps, "left") for row in self.sorted])
        self.squares = (values**2).sum(axis=1)

    def top(self, query_id: int, query: np.ndarray, k: int, levels=LEVELS, rescored: float = RESCORED) -> list[tuple[int, int]]:
        """The (vec_id, score) of the k best vectors other than the query's own."""
        own = self.ids == query_id
        maybe = np.flatnonzero(~own)
        few = max(2 * k, int(rescored * len(own)))
        if len(maybe) > few:
            maybe = self._candidates(query, k, own, few, levels)
        scores = self.values[maybe] @ query
        if len(scores) > k:
            # ids ascend with the place, so a stable sort settles ties
            best = np.argsort(-scores, kind="stable")[:k]
            maybe, scores = maybe[best], scores[best]
        return list(zip(self.ids[maybe].tolist(), scores.astype(np.int64).tolist(), strict=True))

    def _postings(self, query: np.ndarray, dims: np.ndarray, bound: float, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, value, query value) of the postings between the last level and this one; begin and end move inwards."""
        level = np.minimum(np.ceil(bound / (np.abs(query[dims]) * self.step)), self.grid).astype(np.int64)
        head = np.maximum(self.head[dims, level], begin)
        tail = np.minimum(np.maximum(self.tail[dims, level], head), end)
        head = np.minimum(head, end)
        places, values, counts, of = [], [], [], []
        for d, a, b, c, e in zip(dims.tolist(), begin.tolist(), head.tolist(), tail.tolist(), end.tolist(), strict=True):
            for x, y in ((a, b), (c, e)):
                if x < y:
                    places.append(self.order[d, x:y])
                    values.append(self.sorted[d, x:y])
                    counts.append(y - x)
                    of.append(d)
        begin[:], end[:] = head, tail
        if not places:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        return np.concatenate(places), np.concatenate(values), np.repeat(query[of], counts)

    def _candidates(self, query: np.ndarray, k: int, own: np.ndarray, few: int, levels) -> np.ndarray:
        n = len(own)
        dims = np.flatnonzero(query)
        largest = float((np.abs(query) * self.largest).max(initial=0))
        got, rest, asked = np.zeros(n), self.squares.copy(), np.full(n, float(query @ query))
        begin, end = np.zeros(len(dims), np.int64), np.full(len(dims), n)
        lead = min(n, 8 * k)
        for share in levels:
            places, values, query_values = self._postings(query, dims, share * largest, begin, end)
            got += np.bincount(places, values * query_values, n)
            rest -= np.bincount(places, values * values, n)
            asked -= np.bincount(places, query_values * query_values, n)
            # what is not met adds at most the product of what is left of both lengths; 1 is for rounding
            slack = np.sqrt(np.maximum(rest, 0) * np.maximum(asked, 0)) + 1
            # the k-th best of some vectors that lead so far, scored exactly, is a bound that members of the result reach
            leading = np.argpartition(np.where(own, -np.inf, got), n - lead)[n - lead :]
            leading = leading[~own[leading]]
            exact = self.values[leading] @ query
            threshold = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
            possible = ~own & (got + slack >= threshold)
            if np.count_nonzero(possible) <= few:
                return np.flatnonzero(possible)
        return np.flatnonzero(~own)


def index_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """(dims, block, ids, vectors): every vector in one block of about block_rows vectors, dealt by hash."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("dims", F.size("values")).withColumn("block", F.pmod(F.xxhash64("vec_id", "values"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dims", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "values"))).alias("members")), blocks


def search(rows: DataFrame, queries: DataFrame, *, k: int = 5, block_rows: int = BLOCK_ROWS, per_batch: int = QUERIES_PER_BATCH) -> DataFrame:
    """The k best vectors of `rows` for each of `queries`: query_id, rank, vec_id, score.

    Each block of the index meets the queries in batches; a block gives at most k rows for a query, and the best of
    these are the query's result. Both take (vec_id, values) as `quantised` gives them.
    """
    index, blocks = index_blocks(rows, block_rows)
    batches = max(1, -(-queries.count() // per_batch))
    batch = F.pmod(F.xxhash64("vec_id", "values"), F.lit(batches)).cast("int")
    asked = queries.withColumn("dims", F.size("values")).withColumn("batch", batch).groupBy("dims", "batch").agg(F.array_sort(F.collect_list(F.struct("vec_id", "values"))).alias("asked"))
    # the stated queries go to every block: a batch's copies grow with the number of blocks, the blocks are not copied
    pairs = index.join(asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["dims", "block"])
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def matrix(members: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        members = members.values
        values = members.field("values")
        flat = np.asarray(values.flatten(), np.float64)
        return np.asarray(members.field("vec_id")), flat.reshape(len(members), -1)

    def score(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for pair in incoming:
            for r in range(pair.num_rows):
                key = (column(pair, "dims")[r].as_py(), column(pair, "block")[r].as_py())
                if key != at:
                    at, block = key, ImpactBlock(*matrix(column(pair, "members")[r]))
                found = []
                for query_id, query in zip(*matrix(column(pair, "asked")[r]), strict=True):
                    found += [(int(query_id), vec_id, value) for vec_id, value in block.top(int(query_id), query, k)]
                columns = zip(*found, strict=True) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    found = pairs.mapInArrow(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_neighbours(vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """Each row whose id is divisible by `every`, against all other rows."""
    rows = stored(quantised(vectors))
    return search(rows, rows.filter(F.col("vec_id") % every == 0), k=k)
