"""Language identification by error-correcting output codes over character n-grams.

1. Each language gets a codeword of bits.  Up to seven languages have all ways to split them in two; more have the best
   of many drawn codes, by the least distance between two codewords.
2. For each bit a logistic model over hashed n-grams (one to three characters, with word borders) learns to tell the
   languages with that bit from those without it.  Languages weigh the same however many documents they have.
3. A text's margins, one for each bit, are compared with all codewords.  A language's loss is the mean logistic loss of
   its bits, each weighted by how often that bit was right for that language.  The nearest codeword wins; a text is
   flagged as ambiguous where the second comes near.

The models are fitted on at most MAX_ROWS documents of each language, those with the smallest hashes of id and text; all
texts are read whole for the prediction.  The margins of a text are sums over its words, so a word is looked up once.

Documents without language and those held out are not learned from.  A text without a letter (null and empty ones too)
is `und` with score 0.  With one language learned, all other texts are of that language; with none, all are `und`.
Equal losses go to the smaller name.  Repeated rows are predicted each; other columns are not read.  More than
MOST_LANGUAGES different names are refused.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableviews.llm.shared import PieceTable, column, stored, texts_of

UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
MAX_ROWS = 2_000
MOST_LANGUAGES = 512
DIMENSIONS = 1 << 14
PENALTY, ITERATIONS, SEED = 1e-4, 40, 23
EXHAUSTIVE = 7
# A text is ambiguous where the second language's probability reaches this share of the first one's.
NEAR = 0.25
# Characters of texts that are looked up together.
PIECE_CHARS = 1 << 20

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LETTER = regex.compile(r"\p{L}")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is in the fold that is not learned from: by crc32 of its id as text; a null id is the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def codewords(languages: int, seed: int = SEED, draws: int = 200) -> np.ndarray:
    """One row of 1 and -1 for each language; every column has both, and no column is another one or its opposite."""
    if languages < 2:
        return np.ones((languages, 0), np.int64)
    if languages <= EXHAUSTIVE:
        splits = [bits for bits in itertools.product((1, -1), repeat=languages) if bits[0] == 1 and -1 in bits]
        return np.array(splits, np.int64).T
    draw, length, best, least = np.random.default_rng(seed), 15 + math.ceil(10 * math.log2(languages)), None, -1
    for _ in range(draws):
        code = draw.choice((1, -1), size=(languages, 2 * length))
        code = np.unique(code * code[:1], axis=1)
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        code = code[:, draw.permutation(code.shape[1])[:length]]
        apart = (code.shape[1] - code @ code.T) // 2 + len(code[0]) * np.eye(languages, dtype=np.int64)
        if apart.min() > least:
            best, least = code, int(apart.min())
    return best


def letters(piece: str) -> str:
    """The words of a piece of text, small, with blanks between them."""
    return " ".join(WORD.findall(piece.lower()))


def grams(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, piece) of all n-grams of the words of some pieces."""
    words = [letters(piece) for piece in pieces]
    text = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    # a piece's characters and the blank after them
    owner = np.r_[0, np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])].astype(np.int64)[: len(text)]
    blank = text == 32
    mixed = [text * np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    one = ~blank
    two = ~(blank[:-1] & blank[1:])
    three = ~blank[1:-1]
    hashes = [mixed[0][one], (mixed[0][:-1] ^ mixed[1][1:])[two] + np.uint64(1), (mixed[0][:-2] ^ mixed[1][1:-1] ^ mixed[2][2:])[three] + np.uint64(2)]
    owners = [owner[one], np.where(blank[:-1], owner[1:], owner[:-1])[two], owner[1:-1][three]]
    bucket = np.concatenate(hashes)
    bucket ^= bucket >> np.uint64(29)
    return ((bucket * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % DIMENSIONS, np.concatenate(owners)


def cut(text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
    """A text in pieces that end at a blank."""
    begin = 0
    while begin < len(text):
        end = text.find(" ", begin + chars)
        end = len(text) if end < 0 else end
        yield text[begin:end]
        begin = end


def gram_shares(text: str) -> tuple[list[int], list[float]]:
    """The buckets of a text's n-grams and their shares of all of them."""
    counts = np.zeros(DIMENSIONS, np.int64)
    for piece in cut(text):
        counts += np.bincount(grams([piece])[0], minlength=DIMENSIONS)
    found = np.flatnonzero(counts)
    return found.tolist(), (counts[found] / max(1, counts.sum())).tolist()


class LanguageModel:
    """The bit classifiers, the codewords and their weights."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, intercepts: np.ndarray, trust: np.ndarray | None = None):
        """weights: one column for each bit; trust: how often each language's bits were right."""
        self.languages, self.code, self.intercepts = languages, code, intercepts
        # a last column counts n-grams
        self.weights = np.column_stack([weights, np.ones(DIMENSIONS)]).astype(np.float32)
        trust = np.ones(code.shape) if trust is None else np.maximum(trust, 1e-6)
        self.trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-300)
        self.key = uuid.uuid4().hex

    def word_sums(self, pieces: list[str]) -> list[bytes]:
        """For each piece the sums of its n-grams' weights and their number."""
        buckets, owner = grams(pieces)
        order = np.argsort(owner, kind="stable")
        sums = np.zeros((len(pieces), self.weights.shape[1]), np.float32)
        held = np.bincount(owner, minlength=len(pieces))
        some = np.flatnonzero(held)
        if len(some):
            begins = (np.cumsum(held) - held)[some]
            sums[some] = np.add.reduceat(self.weights[buckets[order]], begins, axis=0)
        return [row.tobytes() for row in sums]

    def margins(self, texts: list[str], table: PieceTable) -> tuple[np.ndarray, np.ndarray]:
        """(the margin of each bit, the number of n-grams) for each text."""
        sums = np.zeros((len(texts), self.weights.shape[1]))
        waiting, chars = [], 0

        def look_up() -> None:
            for (at, _), value in zip(waiting, table.encode([piece for _, piece in waiting]), strict=True):
                sums[at] += np.frombuffer(value, "<f4").reshape(-1, sums.shape[1]).sum(axis=0, dtype=np.float64)
            waiting.clear()

        for at, text in enumerate(texts):
            for piece in cut(text):
                waiting.append((at, piece))
                chars += len(piece)
                if chars >= PIECE_CHARS:
                    look_up()
                    chars = 0
        look_up()
        n = sums[:, -1]
        return sums[:, :-1] / np.maximum(n, 1)[:, None] + self.intercepts, n

    def decoded(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest language, its probability, the next one's) for each row of margins."""
        loss = np.stack([(np.logaddexp(0, -margins * code) * trust).sum(axis=1) for code, trust in zip(self.code, self.trust, strict=True)], axis=1)
        likely = np.exp(self.code.shape[1] * (loss.min(axis=1, keepdims=True) - loss))
        likely /= likely.sum(axis=1, keepdims=True)
        first = loss.argmin(axis=1)
        others = likely.copy()
        others[np.arange(len(first)), first] = 0
        return first, likely.max(axis=1), others.max(axis=1)


# The looked-up words of the model that this worker predicts with.
_TABLES: dict[str, PieceTable] = {}


def _table(model: LanguageModel) -> PieceTable:
    if model.key not in _TABLES:
        _TABLES.clear()
        # so many words that the table stays below about 200 MB
        _TABLES[model.key] = PieceTable(model.word_sums, cached=min(500_000, 200_000_000 // (150 + 4 * model.weights.shape[1])))
    return _TABLES[model.key]


def learned_rows(docs: DataFrame, max_rows: int) -> DataFrame:
    """(lang, text) of at most max_rows documents of each language that may be learned from, by the smallest hashes."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    place = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 40))
    counted = own.groupBy("lang").count().collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"{len(counted)} languages; at most {MOST_LANGUAGES} can be learned")
    # first by a bound that lets pass a little more than max_rows, so that few rows are ranked
    bounds = {row["lang"]: min(1.0, (max_rows + 6 * math.sqrt(max_rows) + 6) / row["count"]) for row in counted}
    if not bounds:
        return own.select("lang", "text").limit(0)
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]
    few = own.withColumn("place", place).filter(F.col("place") < bound * float(1 << 40))
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text")))
    return ranked.filter(F.col("rank") <= max_rows).select("lang", "text")


def fit(docs: DataFrame, *, max_rows: int = MAX_ROWS, penalty: float = PENALTY) -> LanguageModel:
    """Learn the bits from the documents that are not held out."""
    texts = stored(learned_rows(docs, max_rows))
    counts = {row["lang"]: row["count"] for row in texts.groupBy("lang").count().collect()}
    languages = sorted(counts)
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((DIMENSIONS, 0)), np.zeros(0))

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [gram_shares(text) for text in texts_of(batch)]
            columns = [column(batch, "lang"), pa.array([i for i, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "buckets", "shares"])

    # rows of a bounded sample, made into vectors one by one
    sparse = F.udf(lambda buckets, shares: Vectors.sparse(DIMENSIONS, buckets, [100 * v for v in shares]), VectorUDT())
    rows = stored(texts.mapInArrow(measured, "lang string, buckets array<int>, shares array<double>").select("lang", sparse("buckets", "shares").alias("x")))
    weights, intercepts = np.zeros((DIMENSIONS, code.shape[1])), np.zeros(code.shape[1])
    for bit in range(code.shape[1]):
        sides = {1: int((code[:, bit] > 0).sum()), -1: int((code[:, bit] < 0).sum())}
        # every language of a side weighs the same, and both sides do
        shares = [sum(counts.values()) / (2 * sides[int(code[at, bit])] * counts[name]) for at, name in enumerate(languages)]
        of = lambda values: F.create_map(*[F.lit(x) for pair in zip(languages, values, strict=True) for x in pair])[F.col("lang")]
        dealt = rows.select("x", of([float(b > 0) for b in code[:, bit].tolist()]).alias("y"), of(shares).alias("w"))
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=penalty, maxIter=ITERATIONS, standardization=False).fit(dealt)
        weights[:, bit], intercepts[bit] = model.coefficients.toArray() * 100, model.intercept
    plain = LanguageModel(languages, code, weights, intercepts)
    return LanguageModel(languages, code, weights, intercepts, trust_of(plain, texts))


def trust_of(model: LanguageModel, texts: DataFrame) -> np.ndarray:
    """How often each bit was right for each language, over the sampled texts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def right(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        row_of = {name: at for at, name in enumerate(model.languages)}
        for batch in batches:
            names = column(batch, "lang").to_pylist()
            margins, _ = model.margins(texts_of(batch), _table(model))
            hits = (margins * model.code[[row_of[name] for name in names]] > 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(hits), pa.list_(pa.float64()))], names=["lang", "hits"])

    seen = texts.mapInArrow(right, "lang string, hits array<double>").select("lang", F.posexplode("hits").alias("bit", "hit"))
    found = np.ones(model.code.shape)
    for row in seen.groupBy("lang", "bit").agg(F.avg("hit").alias("share")).collect():
        found[model.languages.index(row["lang"]), row["bit"]] = row["share"]
    return found


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [*model.languages, UNKNOWN]
        for batch in batches:
            texts = texts_of(batch)
            first, score, second = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts))
            if model.languages:
                margins, n = model.margins(texts, _table(model))
                known = np.flatnonzero(n > 0)
                if len(known):
                    first[known], score[known], second[known] = model.decoded(margins[known])
            columns = [pa.array([names[i] for i in first.tolist()], pa.string()), pa.array(score), pa.array((score > 0) & (second >= NEAR * score))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), *columns], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(told, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def languages_of(docs: DataFrame, **options) -> DataFrame:
    """The language of every row of docs, learned from those of its documents that have one and are not held out."""
    return predict(docs, fit(docs, **options))
