"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark texts are cut into passages of at most `PASSAGE` words. Their words are the vocabulary; each document
   becomes the sequence of its words' numbers, -1 for words no passage has, and is stored as such.
2. Document frequencies of the vocabulary are counted over all documents, for TF-IDF weights.
3. A randomised SVD of TF-IDF rows (the passages and windows of all documents) is computed by Spark jobs that each sum
   A'(A Q) over tasks; what the driver handles is terms x rank. Its right singular vectors map words to the latent space.
4. Windows of every document at the scales of the passages are projected, and the passages whose cosine reaches
   `COSINE` are candidates. Windows that, with their margins, have fewer words of passages than the shortest passage
   of the scale needs are passed over, as no passage could be confirmed there.
5. A candidate is confirmed by the longest common subsequence of the window (with a margin) and the passage, at
   least `COMMON` of the passage, and by the answer: enough of the answer's words (a column `answer`, else the
   passage's rarest words) stand in the window.

Words are runs of letters, digits and underscores in lower case. Null or empty texts match nothing; items of under
`LEAST_WORDS` words and items without id take no part. Repeated rows give the same rows once. A benchmark is handled
in parts of about `ITEMS_PER_PART` items and `PART_CHARS` characters, so what is broadcast is bounded by these; an item
longer than that is a part of its own. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableviews.llm.shared import NULL_ID, WordHashes, column, order_of, pieces_of, sliced, stored, texts_of, word_hash, words_of

ITEMS_PER_PART = 2000
PART_CHARS = 1_000_000
PASSAGE = 64
LEAST_WORDS = 5
SCALES = (12, 20, 32, 48, 64)
RANK, EXTRA, ROUNDS = 64, 8, 2
FIT_WINDOW, SEED = 48, 5
COSINE, COMMON, ANSWER = 0.5, 0.6, 0.5
ANSWER_WORDS = 5
# stands for a word outside the vocabulary
NO_NUMBER = (-1).to_bytes(4, "little", signed=True)
# stand between words often
SIGNS = "\n.,;:!?$%&#*|"


class Passages:
    """The passages of one part of the benchmark and their vocabulary."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        self.item, words, answers = [], [], []
        texts, replies = WordHashes()([t for _, t, _ in items]), WordHashes()([a or "" for _, _, a in items])
        for (item, _, _), text, reply in zip(items, texts, replies, strict=True):
            if len(text) < LEAST_WORDS:
                continue
            parts = -(-len(text) // PASSAGE)
            for part in np.array_split(text, parts):
                self.item.append(item)
                words.append(part)
                answers.append(reply)
        # words of answers have a number as well, so that they are met in documents, but only those of passages are searched by
        self.vocabulary = np.unique(np.concatenate([*words, *answers])) if words else np.zeros(0, np.uint64)
        self.in_passages = np.isin(self.vocabulary, np.concatenate(words)) if words else np.zeros(0, bool)
        self.words = [np.searchsorted(self.vocabulary, w) for w in words]
        self.given = [self.numbers(a) for a in answers]
        self.has_answer = [len(a) > 0 for a in answers]
        spelled = sorted({word for _, text, answer in items for part in (text, answer or "") for piece in pieces_of(part) for word in words_of(piece)})
        hashed = np.array([word_hash(word) for word in spelled], np.uint64)
        self.by_word = {word: n.to_bytes(4, "little", signed=True) for word, n in zip(spelled, self.numbers(hashed).tolist(), strict=True) if n >= 0}

    def __len__(self) -> int:
        return len(self.words)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of words, -1 for words outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(0, len(self.vocabulary) - 1))
        return np.where(self.vocabulary[at] == words, at, -1) if len(self.vocabulary) else np.full(len(words), -1)


def common_length(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, a bit for each element of a."""
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    every = row = (1 << len(a)) - 1
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & every
    return len(a) - row.bit_count()


class WordNumbers(dict):
    """The numbers of the words of each piece of text, 4 bytes each; words are looked up as texts, so none is hashed.

    Only the words of the vocabulary are kept: texts are cut at blanks and signs, and any other piece of letters and
    digits is one word without a number.
    """

    def __init__(self, numbers: dict[str, bytes]):
        super().__init__(numbers)
        self[""] = b""

    def __missing__(self, piece: str) -> bytes:
        if piece.isalnum():
            return NO_NUMBER
        return b"".join([self.get(word, NO_NUMBER) for word in words_of(piece)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """One joined value for each text."""
        found = []
        for text in texts:
            text = text.lower()
            for sign in SIGNS:
                text = text.replace(sign, " ")
            found.append(b"".join(map(self.__getitem__, text.split(" "))))
        return found


def numbered(docs: DataFrame, shared) -> DataFrame:
    """(doc, ids): each document as the numbers of its words, 4 bytes each. Only words of the vocabulary have a number."""
    schema = pa.schema([("doc", pa.int64()), ("ids", pa.binary())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordNumbers(shared.value.by_word)
        for whole in batches:
            for batch in sliced(whole, 256):
                yield pa.RecordBatch.from_arrays([column(batch, "doc"), pa.array(table.encode(texts_of(batch)), pa.binary())], schema=schema)

    return docs.mapInArrow(number, "doc long, ids binary")


def summed(rows: DataFrame, partial, shape: tuple[int, ...], slices: int = 16) -> np.ndarray:
    """The sum over tasks of the arrays that partial(sequences) returns; slices of the array are summed by separate tasks."""

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += partial([np.frombuffer(raw, "<i4") for raw in column(batch, "ids").to_pylist()])
        cut = np.array_split(total, slices)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary())], names=["slice", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            for raw in column(batch, "sums").to_pylist():
                total = total + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.asarray(total).tobytes()], pa.binary())], names=["slice", "sums"])

    table = rows.select("ids").mapInArrow(parts, "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary")
    found = {row["slice"]: np.frombuffer(row["sums"]) for row in table.collect()}
    return np.concatenate([found[k] for k in sorted(found)]).reshape(shape) if found else np.zeros(shape)


def document_frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    def partial(sequences: list[np.ndarray]) -> np.ndarray:
        return sum((np.bincount(np.unique(s[s >= 0]), minlength=terms) for s in sequences), np.zeros(terms))

    return summed(rows, partial, (terms,))


def windows_of(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, windows): the words of some documents that have a number, and the number of the window that each stands in."""
    sizes = []
    for s in sequences:
        each, more = divmod(len(s), n := max(1, len(s) // FIT_WINDOW))
        sizes.append(np.full(n, each, np.int32))
        sizes[-1][:more] += 1
    ids, sizes = np.concatenate(sequences), np.concatenate(sizes)
    place = np.flatnonzero(ids >= 0)
    return ids[place], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[place]


def gram_product(sequences: list[np.ndarray], weights: np.ndarray, basis: np.ndarray, at_once: int = 800) -> np.ndarray:
    """A'(A basis) for the normalised TF-IDF rows of the windows of some documents.

    A is laid out for windows of about `at_once` words in turn, with columns for their own terms only.
    """
    total = np.zeros(basis.shape)
    # the last place of each term among the words of a part, then its column
    slot = np.zeros(len(weights), np.int64)
    for _, group in in_groups(sequences, 200_000):
        terms, window = windows_of(group)
        weighty = weights[terms] > 0
        terms, window = terms[weighty], window[weighty]
        if not len(terms):
            continue
        begins = np.flatnonzero(np.diff(window, prepend=-1))
        row = np.repeat(np.arange(len(begins)), np.diff(begins, append=len(terms)))
        squares = np.add.reduceat(weights[terms] ** 2, begins)
        value = weights[terms] / np.maximum(np.sqrt(squares), 1e-12)[row]
        # each part begins with a window
        cuts = np.unique([*begins[np.searchsorted(begins, np.arange(0, len(terms), at_once), "right") - 1].tolist(), len(terms)]).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            words, place = terms[a:b], np.arange(b - a)
            slot[words] = place
            own = words[slot[words] == place]
            slot[own] = np.arange(len(own))
            first, n = int(row[a]), int(row[b - 1] - row[a]) + 1
            matrix = np.bincount((row[a:b] - first) * len(own) + slot[words], value[a:b], n * len(own)).reshape(n, len(own))
            total[own] += matrix.T @ (matrix @ basis[own])
    return total


def latent_basis(rows: DataFrame, passages: Passages, weights: np.ndarray) -> np.ndarray:
    """terms x rank: the right singular vectors of the documents' windows and the passages, by subspace iteration.

    The passages weigh as much as the documents' windows together, so that the space tells them apart.
    """
    terms = len(weights)
    width = min(terms, RANK + EXTRA)
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((terms, width)))[0]
    own = [np.asarray(w) for w in passages.words]
    n = rows.count()

    def product(basis: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast((weights, basis))
        corpus = summed(rows, lambda sequences: gram_product(sequences, *shared.value), basis.shape)
        mine = gram_product(own, weights, basis)
        balance = np.trace(basis.T @ corpus) / max(1e-12, np.trace(basis.T @ mine)) if n else 1.0
        return corpus + max(1.0, balance) * mine

    for _ in range(ROUNDS):
        basis = np.linalg.qr(product(basis))[0]
    image = product(basis)
    _, vectors = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    return (basis @ vectors[:, ::-1])[:, : min(RANK, width)]


def margin_of(scale: int) -> int:
    """Words on both sides of a window in which a passage is confirmed."""
    return scale // 4


class Retriever:
    """Finds passages in a document's sequence; made once in each task from what was broadcast."""

    def __init__(self, passages: Passages, weights: np.ndarray, basis: np.ndarray):
        self.passages = passages
        latent_map = (weights[:, None] * basis).astype(np.float32)
        # two columns are the parts of one complex number, so that running sums take half as many steps
        even = np.ascontiguousarray(np.pad(latent_map, ((0, 0), (0, latent_map.shape[1] % 2))))
        self.columns = np.ascontiguousarray(even.view(np.complex64).T)
        # one more place, for words without a number
        self.searched = np.append(passages.in_passages, False)
        latent = np.array([latent_map[w].sum(axis=0) for w in passages.words])
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        lengths = np.array([len(w) for w in passages.words])
        scale = np.searchsorted(SCALES, lengths)
        self.scales = [(SCALES[s], members := np.flatnonzero(scale == s), latent[members], COMMON * lengths[members].min()) for s in np.unique(scale).tolist()]
        self.lengths = lengths
        self.has = np.zeros((len(passages), len(weights) + 1), bool)
        self.answers = []
        for k, words in enumerate(passages.words):
            self.has[k, words] = True
            rare = np.array(sorted(set(words.tolist()), key=lambda t: (-weights[t], t))[:ANSWER_WORDS])
            self.answers.append(passages.given[k] if passages.has_answer[k] else rare)

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(scale, passages, first words, cosines) of the windows of a sequence that are near a passage, scale by scale."""
        searched, found = self.searched[ids], []
        place, before = np.flatnonzero(searched), np.zeros(len(ids) + 1, np.int64)
        np.cumsum(searched, out=before[1:])
        for scale, members, latent, least in self.scales:
            starts = np.arange(0, len(ids), max(1, scale // 3))
            margin = margin_of(scale)
            # words of passages before the window, before its end, and in it with its margins
            a, b, low, high = (before[np.clip(starts + x, 0, len(ids))] for x in (0, scale, -margin, scale + margin))
            wide = high - low
            full = np.flatnonzero((wide >= least) & (b > a))
            if len(full):
                found.append((scale, members, latent, starts[full], a[full], b[full]))
        if not found:
            return
        # numpy adds up along the last axis faster
        sums = np.zeros((len(self.columns), len(place) + 1), np.complex64)
        np.cumsum(np.take(self.columns, ids[place], axis=1), axis=1, out=sums[:, 1:])
        for scale, members, latent, starts, a, b in found:
            both = np.take(sums, b, axis=1)
            both -= np.take(sums, a, axis=1)
            vectors = np.ascontiguousarray(both.T).view(np.float32)[:, : latent.shape[1]]
            vectors /= np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-9)[:, None]
            cosines = (vectors @ latent.T).ravel()
            near = np.flatnonzero(cosines >= COSINE)
            window, passage = np.divmod(near, len(members))
            yield scale, members[passage], starts[window], cosines[near]

    def matches(self, sequences: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(sequence, passage, first word, words, common words, cosine) of the confirmed passages, the best window of each.

        Sequences are laid out in a row with gaps between them that are wider than any window with its margins.
        """
        gap = np.full(2 * SCALES[-1], -1)
        ids = np.concatenate([gap, *[x for s in sequences for x in (s, gap)]])
        begins = np.cumsum([len(gap), *[len(s) + len(gap) for s in sequences]])[:-1]
        best: dict[tuple[int, int], tuple] = {}
        for scale, passages, starts, cosines in self.candidates(ids):
            margin = margin_of(scale)
            shape = np.arange(-margin, scale + margin)
            for at in range(0, len(passages), 4096):
                part = passages[at : at + 4096]
                windows = ids[np.clip(starts[at : at + 4096, None] + shape, 0, len(ids) - 1)]
                shared = self.has[part[:, None], windows].sum(axis=1)
                for c in np.flatnonzero(shared >= COMMON * self.lengths[part]).tolist():
                    k, window, cosine = int(part[c]), windows[c], float(cosines[at + c])
                    words = self.passages.words[k]
                    common = common_length(words.tolist(), window[self.has[k][window]].tolist())
                    if common < COMMON * len(words):
                        continue
                    answer = self.answers[k]
                    if np.count_nonzero(np.isin(answer, window) & (answer >= 0)) < ANSWER * len(answer):
                        continue
                    first = int(starts[at + c]) - margin
                    n = int(np.searchsorted(begins, first + int(np.flatnonzero(window >= 0)[0]), "right")) - 1
                    begin, end = max(first, int(begins[n])), min(first + len(window), int(begins[n]) + len(sequences[n]))
                    if (n, k) not in best or (common, cosine) > best[n, k][2:]:
                        best[n, k] = (begin - int(begins[n]), end - begin, common, cosine)
        for (n, k), found in sorted(best.items()):
            yield (n, k, *found)


def in_groups(sequences: list[np.ndarray], words: int = 12_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first, sequences) of groups of about so many words; a longer sequence is a group of its own."""
    first, size = 0, 0
    for k, s in enumerate(sequences):
        if size and size + len(s) > words:
            yield first, sequences[first:k]
            first, size = k, 0
        size += len(s)
    if sequences:
        yield first, sequences[first:]


def _part_matches(docs: DataFrame, items: list[tuple[int, str, str | None]]) -> DataFrame | None:
    passages = Passages(items)
    if not len(passages):
        return None
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(passages)
    rows = stored(numbered(docs, shared))
    frequency = document_frequencies(rows, len(passages.vocabulary))
    weights = (np.log((rows.count() + 1) / (frequency + 1)) + 0.05) * passages.in_passages
    basis = latent_basis(rows, passages, weights)
    model = context.broadcast((weights, basis))
    schema = pa.schema([("doc", pa.int64()), ("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("common", pa.int32()), ("share", pa.float64()), ("cosine", pa.float64())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        retriever = None
        for batch in batches:
            retriever = retriever or Retriever(shared.value, *model.value)
            out = []
            docs_of = column(batch, "doc").to_pylist()
            for first, group in in_groups([np.frombuffer(raw, "<i4") for raw in column(batch, "ids").to_pylist()]):
                for n, k, start, words, common, cosine in retriever.matches(group):
                    out.append((docs_of[first + n], passages.item[k], start, words, common, common / len(passages.words[k]), cosine))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(search, "doc long, item_id long, start int, words int, common int, share double, cosine double")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, start, words, common, share, cosine of the best passage."""
    texts = docs.select(order_of().alias("doc"), F.col("text").cast("string").alias("text"))
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer")).distinct()
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text") + F.length(F.coalesce("answer", F.lit("")))), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS_PER_PART), -(-chars // PART_CHARS))
    found = []
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        if (matches := _part_matches(texts, [tuple(row) for row in rows])) is not None:
            found.append(matches)
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start int, words int, common int, share double, cosine double")
    rows = reduce(DataFrame.unionAll, found)
    best = rows.groupBy("doc", "item_id").agg(F.max(F.struct("share", "common", "cosine", "start", "words")).alias("m"))
    return best.select(F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "item_id", "m.start", "m.words", "m.common", F.round("m.share", 6).alias("share"), F.round("m.cosine", 4).alias("cosine"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no item was found, with their own columns."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__doc"]), "left_anti")
