"""Quality classifier: a sparse ensemble of rules over statistics of whole texts.

1. Each text gives a row of statistics (shares of kinds of characters, repetition, shape of words and lines).
2. A random forest of shallow trees is grown on labelled rows; every path from a root to a node is a rule, a
   conjunction of bounds on statistics.
3. A logistic model with an L1 penalty weighs the rules; most weights become zero.
4. The rules left are compiled into one Spark column expression, which scores all rows in the JVM.

Training reads at most about `max_rows` labelled rows, chosen by a hash of the id; all else covers all rows.
Labels are read from (doc_id, label); a document with several labels has the smallest, labels other than 0 and 1
and null ids are no labels. With labels of one class only, or none, the score is that class's smoothed share.
Null texts are empty and get a score too. Repeated rows are scored each. Other columns are left out of the scores.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableviews.llm.shared import stored, texts_of

MAX_ROWS = 30_000
TREES, DEPTH, SEED = 24, 3, 17
PENALTY = 0.001

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
MARKS = b".,;:'\"()-"
SIGNS = b"#$%&*+/<=>@[\\]^_`{}~"

STATS = [
    "log_chars", "log_words", "word_length", "upper", "digits", "marks", "bangs", "bars", "signs", "beyond_ascii", "blanks",
    "lines_per_100_words", "distinct_words", "repeated_neighbours", "repeated_lines", "one_word_lines", "long_words", "upper_words", "stops_per_line",
]


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of STATS."""
    raw = text.encode("utf-8", "surrogatepass")
    n_bytes, chars, words, lines = len(raw), max(1, len(text)), text.split(), text.split("\n")
    n_words, n_lines = max(1, len(words)), len(lines)
    share = lambda kind: (n_bytes - len(raw.translate(None, kind))) / chars
    lengths = sum(map(len, words))
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        lengths / n_words,
        share(UPPER),
        share(DIGITS),
        share(MARKS),
        raw.count(b"!") / chars,
        raw.count(b"|") / chars,
        share(SIGNS),
        (n_bytes - len(text)) / chars,
        1 - lengths / chars,
        100 * n_lines / n_words,
        len(set(words)) / n_words,
        sum(map(operator.eq, words, words[1:])) / n_words,
        1 - len(set(lines)) / n_lines,
        sum(" " not in line for line in lines) / n_lines,
        sum(len(w) > 14 for w in words) / n_words,
        sum(map(str.isupper, words)) / n_words,
        raw.count(b".") / n_lines,
    ]


# The column that holds a row's statistics, named so that it meets no column of a user.
STATS_COLUMN = "__quality_statistics"


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with the struct of statistics of each whole text; all other columns pass through."""
    fields = ", ".join(f"{name}: double" for name in STATS)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"{STATS_COLUMN} struct<{fields}>").fields])

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(text) for text in texts_of(batch)]).reshape(batch.num_rows, len(STATS))
            struct = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(len(STATS))], STATS)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, STATS_COLUMN])

    return docs.mapInArrow(measured, schema)


def fold(id_col: str = "doc_id") -> Column:
    """A document's fold, 0 to 2: crc32 of its id as text; fold 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)).cast("int")


Rule = tuple[tuple[int, str, float], ...]


def tree_rules(node, path: Rule = ()) -> Iterator[Rule]:
    """The conjunctions on the way to every node below this one."""
    if node.getClass().getSimpleName() != "InternalNode":
        return
    split = node.split()
    at, bound = split.featureIndex(), split.threshold()
    for child, sign in ((node.leftChild(), "<="), (node.rightChild(), ">")):
        rule = tuple(sorted({*path, (at, sign, bound)}))
        yield rule
        yield from tree_rules(child, rule)


def tightest(rule: Rule) -> Rule:
    """A rule with one bound a side for each statistic."""
    bounds: dict[tuple[int, str], float] = {}
    for at, sign, bound in rule:
        best = bounds.get((at, sign), bound)
        bounds[at, sign] = min(best, bound) if sign == "<=" else max(best, bound)
    return tuple(sorted((at, sign, bound) for (at, sign), bound in bounds.items()))


def condition(rule: Rule, names: list[str]) -> str:
    return " AND ".join(f"{STATS_COLUMN}.{names[at]} {sign} {bound!r}D" for at, sign, bound in rule)


class RuleModel:
    """Weighted rules; `score` is their column expression."""

    def __init__(self, names: list[str], rules: list[Rule], weights: list[float], intercept: float):
        kept = [(rule, weight) for rule, weight in zip(rules, weights, strict=True) if weight]
        self.names, self.intercept = names, intercept
        self.rules, self.weights = [r for r, _ in kept], [w for _, w in kept]

    def score(self) -> Column:
        terms = [f"IF({condition(rule, self.names)}, {weight!r}D, 0D)" for rule, weight in zip(self.rules, self.weights, strict=True)]
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'{self.intercept!r}D', *terms])})))")


def sampled_labels(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most max_rows documents that are not held out, chosen by a hash of the id."""
    y = F.col(label).cast("int")
    given = labels.filter(F.col("doc_id").isNotNull() & y.isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(y).alias("__label")).filter(fold() != 1)
    share = math.ceil(1_000_000 * max_rows / max(1, given.count()))
    return given.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < share).limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", max_rows: int = MAX_ROWS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Fit the rules on the sampled labelled documents."""
    # at most max_rows ids and labels, 12 bytes each
    chosen = F.broadcast(sampled_labels(labels, label, max_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(with_statistics(texts.join(chosen, "doc_id").select("__label", "text")).select(F.col("__label").cast("double").alias("y"), STATS_COLUMN))
    n = {int(row["y"]): row["count"] for row in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return RuleModel(STATS, [], [], math.log(share / (1 - share)))
    plain = rows.select("y", STATS_COLUMN, array_to_vector(F.array(*[F.col(f"{STATS_COLUMN}.{name}") for name in STATS])).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=SEED, maxBins=64, minInstancesPerNode=5).fit(plain)
    rules = sorted({tightest(rule) for tree in forest.trees for rule in tree_rules(tree._java_obj.rootNode())})
    if not rules:
        return RuleModel(STATS, [], [], math.log(n[1] / n[0]))
    ruled = plain.select("y", array_to_vector(F.array(*[F.expr(f"IF({condition(rule, STATS)}, 1D, 0D)") for rule in rules])).alias("r"))
    lasso = LogisticRegression(featuresCol="r", labelCol="y", elasticNetParam=1.0, regParam=penalty, maxIter=80).fit(stored(ruled))
    return RuleModel(STATS, rules, [float(w) for w in lasso.coefficients.toArray()], float(lasso.intercept))


def quality_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; the labels of held-out documents are never read for the fit."""
    model = fit(docs, labels, **options)
    scored = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).withColumn("score", model.score())
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, at_least: float = 0.5, **options) -> DataFrame:
    """The rows of docs whose score reaches `at_least`, with their own columns; they are filtered where they are read."""
    model = fit(docs, labels, **options)
    return with_statistics(docs).filter(model.score() >= at_least).select(docs.columns)
