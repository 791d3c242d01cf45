"""Hard negatives by exact inner products, many candidates to one multiplication (Kronecker packing).

The candidates of a block are packed by component: component j of all of them goes into one wide integer, each in a
field of its own, raised by a bias so that no field is negative.  An anchor multiplies each of these integers by its own
component j, raised likewise, and adds the products up: field f of the sum is the inner product of the raised vectors,
and as a field is wide enough for the largest sum that the block and the anchors can give, no field runs into the next.
Taking off what the biases added leaves the exact scores of the whole block.

Two passes go over all blocks.  The first finds each anchor's positives, the best other rows of its label.  The second
finds, for each anchor and positive, the best rows of other labels whose score lies between a share of the positive's
score and that score; the best of the blocks are merged by Spark.  Nothing is left out by a bound.

Components become floor(256 * x).  Rows without id or label, and rows whose vector is null or holds null or non-finite
components, take no part.  Vectors meet only vectors of their own length; empty vectors score 0.  Rows that repeat id,
label and vector count once.  An id with several labels or vectors gives a candidate for each and, as an anchor or a
positive, a result for each; an anchor never meets a row of its own id.  Ties go to the smaller id, then to the smaller
hash of label and vector.  A component or a score beyond 64 bits ends the job.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableviews.llm.shared import column, stored

SCALE = 256
POSITIVES = NEGATIVES = 5
# Shares of a positive's score, in hundredths, between which a negative's score has to lie.
LOW, HIGH = 80, 100
# Candidates packed together, and anchors that meet a block at once.
BLOCK_ROWS = 4096
ANCHORS_PER_BATCH = 128


def labelled(vectors: DataFrame, vector: str = "embedding", label: str = "label", shift_every: int | None = None, labels: int = 10) -> DataFrame:
    """(vec_id, label, values, tag) of the rows that take part; labels of ids divisible by `shift_every` move on by one."""
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # a component beyond 64 bits must not be cut to the largest one
    whole = lambda v: F.when(F.abs(v * SCALE) < F.lit(2.0**63), F.floor(v * SCALE).cast("long")).otherwise(F.raise_error(F.lit("a component times 256 is beyond 64 bits")).cast("long"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & good)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(x, whole).alias("values"))
    if shift_every:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % shift_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    return rows.distinct().withColumn("tag", F.xxhash64("label", "values"))


class PackedBlock:
    """Candidates of one block, one wide integer for each component."""

    def __init__(self, values: np.ndarray):
        """values: one row of integers for each candidate."""
        self.rows, self.dims = values.shape
        self.bias = -int(values.min(initial=0))
        self.most = int(values.max(initial=0)) + self.bias
        # Python's integers where a raised component, or a sum of components, could pass 64 bits
        self.raised = values + self.bias if self.most < 2**63 else values.astype(object) + self.bias
        self.sums = values.sum(axis=1) if self.dims * (self.most + self.bias) < 2**63 else [sum(row) for row in values.tolist()]
        self.width, self.packed = 0, []

    def _pack(self, width: int) -> None:
        """One integer a component, with fields of `width` bytes."""
        if self.most < 2**63 and width <= 8:
            fields = np.ascontiguousarray(self.raised.T).astype("<i8").view("u1").reshape(self.dims, self.rows, 8)[:, :, :width]
            self.packed = [int.from_bytes(fields[j].tobytes(), "little") for j in range(self.dims)]
        else:
            self.packed = [int.from_bytes(b"".join(int(v).to_bytes(width, "little") for v in self.raised[:, j]), "little") for j in range(self.dims)]
        self.width = width

    def ready_for(self, anchor_most: int) -> None:
        """Fields that hold the largest sum of products with anchors whose raised components reach anchor_most."""
        largest = max(1, self.most, self.dims * self.most * anchor_most)
        width = -(-largest.bit_length() // 8)
        if width > self.width:
            self._pack(width)

    def scores(self, anchor: list[int], anchor_bias: int) -> np.ndarray:
        """The exact inner product of every candidate with one anchor."""
        total = 0
        for component, packed in zip(anchor, self.packed, strict=True):
            total += (component + anchor_bias) * packed
        raw = np.frombuffer(total.to_bytes(self.rows * self.width, "little"), "u1").reshape(self.rows, self.width)
        fixed = self.bias * sum(anchor) + self.dims * self.bias * anchor_bias
        if self.width <= 7 and isinstance(self.sums, np.ndarray) and fixed.bit_length() < 62 and anchor_bias * self.dims * (self.most + self.bias) < 2**61:
            wide = np.zeros((self.rows, 8), "u1")
            wide[:, : self.width] = raw
            return wide.view("<i8").ravel() - fixed - anchor_bias * self.sums
        exact = [int.from_bytes(field.tobytes(), "little") - fixed - anchor_bias * int(own) for field, own in zip(raw, self.sums, strict=True)]
        return np.array(exact, np.int64)  # a score beyond 64 bits ends the job here


def members(row: pa.Scalar, dims: int) -> dict[str, np.ndarray]:
    """The columns of an array of structs, the vectors as one matrix."""
    structs = row.values
    found = {name: np.asarray(structs.field(name)) for name in ("vec_id", "label", "tag")}
    found["values"] = np.asarray(structs.field("values").flatten(), np.int64).reshape(len(structs), dims)
    return found


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores among the allowed ones; ties to the smaller place."""
    places = np.flatnonzero(allowed)
    if len(places) > k:
        own = scores[places]
        bound = np.partition(own, len(own) - k)[len(own) - k]
        places = places[own >= bound]
    return places[np.argsort(-scores[places], kind="stable")][:k]


PAIRS = "anchor_id long, anchor_tag long, of_id long, of_tag long, of_score long, vec_id long, tag long, score long"
PAIR_SCHEMA = pa.schema([(name.split()[0], pa.int64()) for name in PAIRS.split(", ")])


def _blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """(dims, block, members): every row in one block of about block_rows rows, dealt by hash, not by label."""
    blocks = max(1, -(-rows.count() // block_rows))
    dealt = rows.withColumn("dims", F.size("values")).withColumn("block", F.pmod(F.xxhash64("vec_id", "tag"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dims", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "tag", "label", "values"))).alias("members")), blocks


def _met(blocks: DataFrame, n_blocks: int, anchors: DataFrame, wanted: Column, per_batch: int, choose) -> DataFrame:
    """PAIRS rows that `choose` takes from the scores of each anchor with each block.

    The stated anchors go to all blocks in batches, so copies of anchors, not of blocks, cross the network.
    wanted: what an anchor's row carries along besides its vector, a struct column.
    """
    batches = max(1, -(-anchors.count() // per_batch))
    batch = F.pmod(F.xxhash64("vec_id", "tag"), F.lit(batches)).cast("int")
    asked = anchors.withColumn("dims", F.size("values")).groupBy("dims", batch.alias("batch")).agg(F.collect_list(F.struct("vec_id", "label", "tag", "values", wanted.alias("wanted"))).alias("asked"))
    pairs = blocks.join(asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))), ["dims", "block"])

    def scored(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, packed = None, None, None
        for batch in incoming:
            for r in range(batch.num_rows):
                dims = column(batch, "dims")[r].as_py()
                key = (dims, column(batch, "block")[r].as_py())
                if key != at:
                    at, block = key, members(column(batch, "members")[r], dims)
                    packed = PackedBlock(block["values"])
                row = column(batch, "asked")[r]
                asking, carried = members(row, dims), row.values.field("wanted").to_pylist()
                bias = -int(asking["values"].min(initial=0))
                packed.ready_for(int(asking["values"].max(initial=0)) + bias)
                found: list[tuple] = []
                for a, (anchor_id, anchor_tag, anchor_label) in enumerate(zip(asking["vec_id"].tolist(), asking["tag"].tolist(), asking["label"].tolist(), strict=True)):
                    scores = packed.scores(asking["values"][a].tolist(), bias)
                    for of, places in choose(block, scores, anchor_id, anchor_label, carried[a]):
                        found += [(anchor_id, anchor_tag, *of, *more) for more in zip(block["vec_id"][places].tolist(), block["tag"][places].tolist(), scores[places].tolist(), strict=True)]
                columns = zip(*found, strict=True) if found else [[]] * len(PAIR_SCHEMA)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PAIR_SCHEMA)

    return pairs.mapInArrow(scored, PAIRS)


def _merged(found: DataFrame, k: int, *of: str) -> DataFrame:
    """The k best rows for each anchor (and `of`), with their rank."""
    order = Window.partitionBy("anchor_id", "anchor_tag", *of).orderBy(F.desc("score"), "vec_id", "tag")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, per_batch: int = ANCHORS_PER_BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows, anchors: (vec_id, label, values, tag) as `labelled` gives them, stored, as both passes read them.  A negative's
    score times 100 lies between low and high times the positive's score.
    """
    blocks, n_blocks = _blocks(rows, block_rows)
    blocks = stored(blocks)

    def same_label(block, scores, anchor_id, anchor_label, _):
        yield (None, None, None), best(scores, (block["label"] == anchor_label) & (block["vec_id"] != anchor_id), positives)

    nothing = F.struct(F.lit(0).alias("none"))
    near = stored(_merged(_met(blocks, n_blocks, anchors, nothing, per_batch, same_label), positives).select("anchor_id", "anchor_tag", "vec_id", "tag", "score"))
    # at most `positives` for each anchor
    known = near.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_tag").alias("tag")).agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), F.col("tag").alias("tag"), "score")).alias("positives"))
    with_positives = anchors.join(known, ["vec_id", "tag"])

    def other_label(block, scores, anchor_id, anchor_label, carried):
        other = (block["label"] != anchor_label) & (block["vec_id"] != anchor_id)
        for positive in carried:
            score = positive["score"]
            # 100 * s lies between low * score and high * score: bounds on s in whole numbers, exact at any size
            least, most = max(-(-low * score // 100), -(2**63)), min(high * score // 100, 2**63 - 1)
            if least <= most:
                yield (positive["id"], positive["tag"], score), best(scores, other & (scores >= least) & (scores <= most), negatives)

    hard = _merged(_met(blocks, n_blocks, with_positives, F.col("positives"), per_batch, other_label), negatives, "of_id", "of_tag")
    return hard.select(
        "anchor_id",
        F.col("of_id").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("of_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def hard_negatives(vectors: DataFrame, *, every: int = 100, shift_every: int | None = 7, **options) -> DataFrame:
    """Negatives for every row whose id is divisible by `every`, against all rows."""
    rows = stored(labelled(vectors, shift_every=shift_every))
    return mine(rows, rows.filter(F.col("vec_id") % every == 0), **options)
