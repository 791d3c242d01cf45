"""What the operators share: cached encodings of text pieces, files in the shared folder, ordered batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableviews.session import checkpoint_folder, filesystem, new_folder, ship_package, stored

# Stands for a null id where ids are ordered: before all others, as in Spark.
NULL_ID = -(2**63)

# Pieces longer than this are encoded anew each time; a table is emptied when it
# holds this many pieces, so a worker's memory stays bounded.
LONGEST_CACHED = 48
CACHED_PIECES = 500_000

WORD = re.compile(r"\w+")

__all__ = ["NULL_ID", "PieceTable", "WordHashes", "batches_by_key", "checkpoint_folder", "column", "filesystem", "new_folder", "numbered", "pieces_of", "ship_package", "stored", "text_tag", "texts_of", "word_hash", "words_of"]


class PieceTable(dict):
    """The bytes that stand for each blank-separated piece of text.

    The pieces of a batch that are met for the first time are made together by `fill`, each once.
    """

    def __init__(self, fill: Callable[[list[str]], list[bytes]], cached: int = CACHED_PIECES):
        super().__init__()
        self.fill, self.cached = fill, cached

    def encode(self, texts: list[str]) -> list[bytes]:
        """One joined value for each text."""
        parts = [pieces_of(text) for text in texts]
        new = [piece for piece in set().union(*parts) if piece not in self]
        if new:
            self.update(zip(new, self.fill(new), strict=True))
        values = [b"".join(map(self.__getitem__, part)) for part in parts]
        if len(self) > self.cached:
            self.clear()
        else:
            for piece in new:
                if len(piece) > LONGEST_CACHED:
                    del self[piece]
        return values


def pieces_of(text: str) -> list[str]:
    """The blank-separated pieces of a text."""
    return text.replace("\n", " ").split(" ")


def words_of(piece: str) -> list[str]:
    """The words of a piece of text."""
    # most pieces are one word with signs around it
    word = piece.strip(".,;:!?$%&#*|").lower()
    return [word] if word.isalnum() else WORD.findall(piece.lower())


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _word_hashes(pieces: list[str]) -> list[bytes]:
    def of(piece: str) -> bytes:
        words = words_of(piece)
        return word_hash(words[0]).to_bytes(8, "little") if len(words) == 1 else b"".join([word_hash(word).to_bytes(8, "little") for word in words])

    return [of(piece) for piece in pieces]


class WordHashes:
    """64-bit hashes of the words of a text: lower case, runs of letters, digits and underscores."""

    def __init__(self) -> None:
        self.table = PieceTable(_word_hashes)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(value, "<u8") for value in self.table.encode(texts)]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [text or "" for text in column(batch, name).to_pylist()]


def sliced(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def batches_by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches that are sorted by the keys.

    A table holds all groups that end inside a batch; the last, open group waits for the next one.
    """
    open_part: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # the place where the last group of the batch begins
        same = np.ones(batch.num_rows, bool)
        for key in keys:
            values = column(batch, key)
            same &= np.asarray(pc.equal(values, values[batch.num_rows - 1]).fill_null(False))
        breaks = np.flatnonzero(~same)
        if not len(breaks):
            first = open_part and all(column(open_part[0], k)[0] == column(batch, k)[0] for k in keys)
            if open_part and not first:
                yield pa.Table.from_batches(open_part)
                open_part = []
            open_part.append(batch)
            continue
        cut = int(breaks[-1]) + 1
        yield pa.Table.from_batches([*open_part, batch.slice(0, cut)])
        open_part = [batch.slice(cut)]
    if open_part:
        yield pa.Table.from_batches(open_part)


def order_of(id_col: str = "doc_id"):
    """An id that is never null, in the order of ids."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def text_tag(text_col: str = "text"):
    """A hash of a text; null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) of all rows, and what doc means: (doc, id, tag), or nothing where it is the id itself.

    Rows of one id (or without one) with different texts are documents of their own. Where there are such rows, doc
    numbers the pairs of id and text in the order of ids.
    """
    own = docs.select(order_of().alias("doc"), F.col("text").cast("string").alias("text"))
    if own.groupBy("doc").count().filter("count > 1").isEmpty():
        return own, None
    tagged = own.select(F.col("doc").alias("id"), "text", text_tag().alias("tag"))
    pairs = stored(tagged.select("id", "tag").distinct().orderBy("id", "tag").withColumn("doc", F.monotonically_increasing_id()))
    return tagged.join(pairs, ["id", "tag"]).select("doc", "text"), pairs


def with_ids(rows: DataFrame, pairs: DataFrame | None, **names: str) -> DataFrame:
    """rows with an id under each new name for the doc in the column named: the opposite of `numbered`."""
    for new, old in names.items():
        if pairs is None:
            rows = rows.withColumn(new, F.col(old))
        else:
            rows = rows.join(pairs.select(F.col("doc").alias(old), F.col("id").alias(new)), old)
        rows = rows.withColumn(new, F.nullif(F.col(new), F.lit(NULL_ID)))
    return rows
