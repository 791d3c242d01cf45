"""Ranked lexical search without a document index: an Aho-Corasick automaton of all item terms reads the texts.

1. The items' terms are guarded by a blank on both sides and put into one automaton for each part of the items; it is
   broadcast, and one pass over a text meets every occurrence of every term as a whole word (the blank between two
   words belongs to both).  The outputs are term numbers; their counts are the term frequencies of a document.
2. The counts are stored.  Document frequencies, the number of documents and of their terms are aggregated over all of
   them, which gives the weight of each term.
3. The counts are read again; each term number leads to the items that hold it, and the parts of a document's score are
   added up by item.  A task keeps the best documents of each item; these meet in a window, first by salt.

Terms are runs of ASCII letters and digits and of all characters from U+0080 on; only A-Z are lower-cased.  Null and
empty texts have no terms and are never found.  Each row of documents is a document of its own; equal scores go by
ascending doc_id, null first, and then by the number of terms.  Rows of items that share an id are one item with the
terms of all; an item without terms, or whose terms stand nowhere, gives no row.  Other columns are not read.

Items are dealt by hash into parts of about PART_ITEMS items and PART_CHARS characters, so what is broadcast at once
has a bound that does not grow with the documents; an item longer than that is a part's whole content.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableviews.llm.shared import NULL_ID, column, order_of, stored, texts_of

BEST = 10
PART_ITEMS = 2_000
PART_CHARS = 1_000_000
# Bytes of one text that the automaton reads at once, and places of the item lists that are added up at once.
PIECE_BYTES = 1 << 20
PLACES = 1 << 20
# Ways among which an item's best rows are dealt before they meet.
SALTS = 32

# What each byte of UTF-8 becomes: A-Z small, other letters, digits and bytes beyond ASCII as they are, the rest a blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """A text's terms with blanks between them, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLDED)


def terms_of(text: str) -> list[bytes]:
    return folded(text).split()


class TermAutomaton:
    """Finds the guarded terms in folded texts."""

    def __init__(self, terms: list[bytes]):
        self.found = ahocorasick.Automaton()
        for number, term in enumerate(terms):
            # one character for each byte, so that automaton and texts stay small
            self.found.add_word((b" " + term + b" ").decode("latin-1"), number)
        self.found.make_automaton()
        self.empty = not terms

    def counts(self, text: bytes, piece_bytes: int = PIECE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers in ascending order, their counts)."""
        if self.empty:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        totals: dict[int, int] = {}
        begin = 0
        while begin < len(text):
            # pieces end at a blank, which is the next one's guard
            end = text.find(b" ", begin + piece_bytes)
            end = len(text) if end < 0 else end
            numbers, times = np.unique(np.fromiter((n for _, n in self.found.iter(f" {text[begin:end].decode('latin-1')} ")), np.int64), return_counts=True)
            if not begin and end == len(text):
                return numbers, times
            for number, n in zip(numbers.tolist(), times.tolist(), strict=True):
                totals[number] = totals.get(number, 0) + n
            begin = end
        numbers = np.array(sorted(totals), np.int64)
        return numbers, np.array([totals[n] for n in numbers.tolist()], np.int64)


# The automaton of the part that this worker reads for.
_AUTOMATA: dict[str, TermAutomaton] = {}


def _automaton(key: str, terms: list[bytes]) -> TermAutomaton:
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = TermAutomaton(terms)
    return _AUTOMATA[key]


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of each item, in byte order."""
    texts = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.array([sorted(set(terms_of(text))) for text in texts_of(batch)], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([column(batch, "item_id"), lists], names=["item_id", "terms"])

    rows = texts.mapInArrow(split, "item_id long, terms array<binary>")
    return rows.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


class ItemPart:
    """Items with their terms, numbered for this part."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.ids = [item for item, _ in items]
        self.terms = sorted({term for _, terms in items for term in terms})
        self.key = uuid.uuid4().hex
        number = {term: n for n, term in enumerate(self.terms)}
        pairs = [(number[term], at) for at, (_, terms) in enumerate(items) for term in terms]
        held = np.array(pairs, np.int64).reshape(-1, 2)
        held = held[np.argsort(held[:, 0], kind="stable")]
        # the items of term t are of[starts[t] : starts[t + 1]]
        self.of = held[:, 1].copy()
        self.starts = np.searchsorted(held[:, 0], np.arange(len(self.terms) + 1))
        self.most_terms = max((len(terms) for _, terms in items), default=0)


def parts_of(items: DataFrame, part_items: int, part_chars: int) -> Iterator[ItemPart]:
    """The items in parts of bounded size, one at a time."""
    listed = stored(items.withColumn("chars", F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.length(t) + 1)))
    n, chars = listed.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    parts = max(1, -(-n // part_items), -(-chars // part_chars))
    for part in range(parts):
        rows = listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id").collect()
        if rows:
            yield ItemPart([(row["item_id"], [bytes(term) for term in row["terms"]]) for row in rows])


def term_counts(docs: DataFrame, part: ItemPart) -> DataFrame:
    """(doc_id, n, terms, times) of all rows of docs: how many terms a text has, and the counts of those of the part."""
    shared = docs.sparkSession.sparkContext.broadcast(part.terms)
    key = part.key

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(key, shared.value)
        for batch in batches:
            lengths, numbers, times, ends = [], [], [], [0]
            for text in texts_of(batch):
                plain = folded(text)
                found, counts = automaton.counts(plain)
                lengths.append(len(plain.split()))
                numbers.append(found)
                times.append(counts)
                ends.append(ends[-1] + len(found))
            offsets = pa.array(ends, pa.int32())
            flat = [np.concatenate([*x, np.zeros(0, np.int64)]) for x in (numbers, times)]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(flat[0], pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(flat[1], pa.int64()))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    texts = docs.select(order_of().alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(scan, "doc_id long, n long, terms array<int>, times array<long>")


def length_norm(n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """m of documents with n terms, in whole numbers."""
    if docs * 90 * int(n.max(initial=0)) < 2**63:
        return 10 + 90 * n * docs // length
    return np.array([10 + 90 * x * docs // length for x in n.tolist()], np.int64)


class BestByItem:
    """The best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows = np.zeros((0, 4), np.int64)  # item, score, doc_id, n
        self.bound = np.zeros(items, np.int64)  # the k-th best score, 0 while there are fewer

    def add(self, scores: np.ndarray, docs: np.ndarray, lengths: np.ndarray) -> None:
        """scores: one row for each document, one column for each item."""
        doc, item = np.nonzero((scores > 0) & (scores >= self.bound))
        if not len(doc):
            return
        rows = np.concatenate([self.rows, np.column_stack([item, scores[doc, item], docs[doc], lengths[doc]])])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        begins = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        place = np.arange(len(rows)) - np.repeat(begins, np.diff(np.r_[begins, len(rows)]))
        last = place == self.k - 1
        self.bound[rows[last, 0]] = rows[last, 1]
        self.rows = rows[place < self.k]


def best_documents(counts: DataFrame, part: ItemPart, weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """(item_id, score, doc_id, n): the best rows of each task for each item of the part."""
    shared = counts.sparkSession.sparkContext.broadcast((part.ids, part.starts, part.of, weights))
    # a score is a sum of that many products below 10^6 times the largest weight; doubles hold them exactly below 2^53
    exact = int(weights.max(initial=0)) * 1_000_000 * part.most_terms < 2**53
    schema = pa.schema([("item_id", pa.int64()), ("score", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, starts, of, weight = shared.value
        n_items, held = len(items), np.diff(starts)
        best = BestByItem(n_items, k)
        for batch in batches:
            ids, n = (np.asarray(column(batch, name)) for name in ("doc_id", "n"))
            lists = column(batch, "terms")
            offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            terms, times = np.asarray(lists.flatten(), np.int64), np.asarray(column(batch, "times").flatten(), np.int64)
            row = np.repeat(np.arange(len(ids)), np.diff(offsets))
            m = length_norm(n, n_docs, length)
            worth = weight[terms] * (1_000_000_000 * times // (1000 * times + 8 * m[row]))
            # documents are taken together while the item lists of their terms, and their rows of scores, stay within PLACES
            places = np.r_[0, np.cumsum(np.maximum(np.bincount(row, held[terms], len(ids)).astype(np.int64), n_items))]
            begin = 0
            while begin < len(ids):
                end = max(begin + 1, int(np.searchsorted(places, places[begin] + PLACES, "right")) - 1)
                a, b = offsets[begin], offsets[end]
                copies = held[terms[a:b]]
                first = np.repeat(starts[terms[a:b]] - (np.cumsum(copies) - copies), copies)
                cell = np.repeat((row[a:b] - begin) * n_items, copies) + of[first + np.arange(len(first))]
                if exact:
                    sums = np.bincount(cell, np.repeat(worth[a:b], copies), (end - begin) * n_items).astype(np.int64)
                else:
                    sums = np.zeros((end - begin) * n_items, np.int64)
                    np.add.at(sums, cell, np.repeat(worth[a:b], copies))
                best.add(sums.reshape(end - begin, n_items), ids[begin:end], n[begin:end])
                begin = end
        columns = [[items[i] for i in best.rows[:, 0].tolist()], *best.rows.T[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return counts.filter("n > 0").mapInArrow(score, "item_id long, score long, doc_id long, n long")


def rank_items(docs: DataFrame, items: DataFrame, *, k: int = BEST, part_items: int = PART_ITEMS, part_chars: int = PART_CHARS) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    ranked = []
    for part in parts_of(item_terms(items), part_items, part_chars):
        counts = stored(term_counts(docs, part))
        n_docs, length = counts.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        # one row a term of the part, which is bounded
        held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
        if not held:
            continue
        weights = np.zeros(len(part.terms), np.int64)
        for term, n in held:
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
        rows = best_documents(counts, part, weights, n_docs, length, k)
        order = [F.desc("score"), "doc_id", "n"]
        salted = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
        few = rows.withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= k)
        final = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
        ranked.append(final.select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif(F.col("doc_id"), F.lit(NULL_ID)).alias("doc_id"), "score"))
    if not ranked:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = ranked[0]
    for more in ranked[1:]:
        result = result.union(more)
    return result
