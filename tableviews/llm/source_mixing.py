"""Mixing sources to target weights by iterative proportional fitting.

1. Each document has a number of tokens (blank-separated words) and a topic: the nearest of `TOPICS` centroids of
   profiles, which k-means finds on all of them. A profile counts the shapes of all words (length, kind of first
   character) and is taken relative to its language's mean, so topics cut across languages. With the argument `topic`
   that column's whole numbers are taken instead; what is no whole number is topic -1.
2. Tokens are summed over all documents by (source, language, topic).
3. The cells are raked: weights are scaled to the target share of every source, then of every language, then of every
   topic, until all three agree with their targets within `TOLERANCE`. Targets that the present cells cannot meet together are
   told in a warning. With `trim` a cell's ratio of wanted to present share is kept between two numbers after each
   round; margins missed by that are told too.
4. A document's probability is its cell's ratio of wanted to present tokens, scaled so that the largest is 1; a hash of
   its id against that probability says whether it stays. Chances differ by cell only, so expected token shares meet
   the targets.

Without given targets, a dimension's targets are its own shares to the power `TEMPER`, scaled to 1, which lifts small
groups. Null sources, languages and texts are groups and texts of their own (the empty string). Documents without
tokens weigh nothing and have their cell's probability. Null ids are drawn by their texts. Repeated rows are drawn
alike. With an empty table the result is empty.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableviews.llm.shared import PieceTable, column, sliced, stored, texts_of

TOPICS = 8
BUCKETS = 64
PER_PART = 100_000
TEMPER = 0.7
SEED = 11
DIMENSIONS = ("__source", "__lang", "__topic")
# rounds at most, and rounds without progress after which targets are out of reach
ROUNDS, STILL, TOLERANCE = 10_000, 100, 0.005
OWN = ["__tokens", "__profile"]


def _buckets(pieces: list[str]) -> list[bytes]:
    """The shape of each word: its length up to 16 and the kind of its first character."""
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    return [bytes([4 * (min(len(piece), 16) - 1) + kind(piece[0])]) if piece.strip() else b"" for piece in pieces]


def with_profile(docs: DataFrame) -> DataFrame:
    """docs with the number of words and the normalised counts of the word shapes of each whole text."""
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("__tokens long, __profile array<float>").fields])

    def profile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(_buckets)
        for whole in batches:
            for batch in sliced(whole, 256):
                codes = [np.frombuffer(raw, np.uint8) for raw in table.encode(texts_of(batch))]
                counts = np.sqrt(np.array([np.bincount(c, minlength=BUCKETS) for c in codes], np.float32).reshape(len(codes), BUCKETS))
                counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)
                profiles = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, BUCKETS), pa.int32()), pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(c) for c in codes], pa.int64()), profiles], names=[*batch.schema.names, *OWN])

    return docs.mapInArrow(profile, schema)


def topic_model(profiles: DataFrame, topics: int = TOPICS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Mean profiles by language, and centroids of what profiles differ from these, of all rows."""
    vector = array_to_vector(F.col("__profile").cast("array<double>")).alias("x")
    # one row for each language
    means = {row["__lang"]: row["m"].toArray().round(9) for row in profiles.select("__lang", vector).groupBy("__lang").agg(Summarizer.mean(F.col("x")).alias("m")).collect()}
    if not means:
        return means, np.zeros((1, BUCKETS))
    # dealt by their keys and in their order, so that the topics don't depend on how the input is dealt
    parts = -(-profiles.count() // PER_PART)
    dealt = profiles.select("__key", "__lang", "__profile").repartition(parts, "__key", "__lang").sortWithinPartitions("__key", "__lang", "__profile")
    fitted = stored(centred(dealt.select("__lang", "__profile"), means).select(array_to_vector("__centred").alias("x")))
    # by rows, as the solver by blocks fails where there are fewer different profiles than topics
    return means, np.array(KMeans(k=topics, seed=SEED, featuresCol="x", maxIter=15, initSteps=2, solver="row").fit(fitted).clusterCenters())


def _differences(batch: pa.RecordBatch, means: dict[str, np.ndarray]) -> np.ndarray:
    rows = np.asarray(column(batch, "__profile").flatten(), np.float64).reshape(batch.num_rows, BUCKETS)
    nothing = np.zeros(BUCKETS)
    return rows - np.array([means.get(lang, nothing) for lang in column(batch, "__lang").to_pylist()]).reshape(rows.shape)


def centred(profiles: DataFrame, means: dict[str, np.ndarray]) -> DataFrame:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = _differences(batch, means).ravel()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BUCKETS), pa.int32()), pa.array(flat))], names=["__centred"])

    return profiles.mapInArrow(rows, "__centred array<double>")


def with_topic(profiles: DataFrame, means: dict[str, np.ndarray], centroids: np.ndarray) -> DataFrame:
    """profiles with the number of the nearest centroid in place of the profile; ties go to the smaller number."""
    kept = [c for c in profiles.columns if c != "__profile"]
    schema = StructType([*[profiles.schema[c] for c in kept], *StructType.fromDDL("__topic int").fields])
    halves = (centroids**2).sum(axis=1) / 2

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topic = (halves - _differences(batch, means) @ centroids.T).argmin(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], pa.array(topic, pa.int32())], names=[*kept, "__topic"])

    return profiles.mapInArrow(label, schema)


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """(dimension, target): shares to a power, scaled to 1."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).filter("t > 0").withColumn("p", F.pow(F.col("t").cast("double"), F.lit(power)))
    return sums.select(dimension, (F.col("p") / F.lit(_one(sums, F.sum("p")) or 1.0)).alias("target"))


def _one(rows: DataFrame, number) -> float:
    """A single aggregate of a table."""
    return float(rows.agg(number).first()[0] or 0.0)


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, trim: tuple[float, float] | None = None) -> DataFrame:
    """Cells with `weight`, whose sums over each dimension are the targets' shares. cells: the dimensions and tokens > 0.

    The rounds run on the driver, on one number for each cell and dimension: cells are combinations of categories, not
    documents. Categories without a target, or without cells, are left out and the targets scaled to the rest.
    """
    for dimension, target in targets.items():
        cells = cells.join(target.select(dimension, F.col("target").alias(f"t{dimension}")), dimension)
    cells = stored(cells)
    spark, table = cells.sparkSession, cells.toArrow()
    share = np.asarray(table["tokens"], np.float64)
    share = share / max(share.sum(), 1e-300)
    codes, wanted = {}, {}
    for dimension in targets:
        code = table[dimension].combine_chunks().dictionary_encode()
        codes[dimension] = np.asarray(code.indices, np.int64)
        goal = np.zeros(len(code.dictionary))
        goal[codes[dimension]] = np.asarray(table[f"t{dimension}"], np.float64)
        wanted[dimension] = goal / max(goal.sum(), 1e-300)
    weight, history = share.copy(), []
    sums = lambda d: np.bincount(codes[d], weight, len(wanted[d]))
    missed = lambda d: float(np.abs(sums(d) - wanted[d]).max(initial=0))
    off = lambda d: float(np.abs(sums(d) / np.maximum(wanted[d], 1e-300) - 1)[wanted[d] > 0].max(initial=0))
    for _ in range(rounds):
        for d in targets:
            weight = weight * (wanted[d] / np.maximum(sums(d), 1e-300))[codes[d]]
        if trim:
            weight = np.clip(weight, share * trim[0], share * trim[1])
        history.append(max(map(off, targets)))
        if history[-1] <= tolerance or (len(history) > STILL and history[-1] > 0.999 * history[-1 - STILL]):
            break
    if history and history[-1] > tolerance:
        warnings.warn("targets are missed by a share of up to " + ", ".join(f"{missed(d):.4f} ({d.strip('_')})" for d in targets), stacklevel=2)
    held = table.select([*targets, "tokens"]).append_column("share", pa.array(share)).append_column("weight", pa.array(weight))
    return spark.createDataFrame(held)


def mixed(docs: DataFrame, *, targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, topics: int = TOPICS, topic: str | None = None, seed: int = SEED, trim: tuple[float, float] | None = None) -> DataFrame:
    """docs with __tokens, __topic, __probability and __kept."""
    targets = targets or {}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.xxhash64("text")))
    given = topic is not None
    base = docs.select("doc_id", "text", "source", "lang", *([F.col(topic).alias("__given")] if given else [])).withColumn("__key", key)
    profiles = stored(with_profile(base).select("doc_id", "__key", text("source").alias("__source"), text("lang").alias("__lang"), *([F.coalesce(F.col("__given").try_cast("int"), F.lit(-1)).alias("__topic")] if given else []), *OWN))
    labelled = profiles.drop("__profile") if given else with_topic(profiles, *topic_model(profiles, topics))
    cells = stored(labelled.groupBy(*DIMENSIONS).agg(F.sum("__tokens").alias("tokens")))
    present = cells.filter("tokens > 0")
    wanted = {d: targets[d] if d in targets else stored(tempered(present, d, temper)) for d in DIMENSIONS}
    weights = raked(present, wanted, trim=trim).select(*DIMENSIONS, (F.col("weight") / F.col("share")).alias("ratio"))
    probability = weights.withColumn("__probability", F.col("ratio") / F.lit(_one(weights, F.max("ratio")) or 1.0)).drop("ratio")
    drawn = labelled.join(probability, list(DIMENSIONS), "left").withColumn("__probability", F.coalesce("__probability", F.lit(0.0)))
    return drawn.withColumn("__kept", (F.pmod(F.xxhash64(F.lit(seed), "__key"), F.lit(1 << 40)) / float(1 << 40)) < F.col("__probability"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, source, lang, topic, probability and kept for every row of docs."""
    return mixed(docs, **options).select("doc_id", F.col("__tokens").alias("n_tokens"), F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.round("__probability", 9).alias("probability"), F.col("__kept").alias("kept"))


def sample_mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that were drawn, with their own columns."""
    drawn = mixed(docs, **options).filter("__kept").select("__key").distinct()
    key = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text "), F.xxhash64(docs["text"])))
    return docs.join(drawn, key == drawn["__key"], "left_semi")
