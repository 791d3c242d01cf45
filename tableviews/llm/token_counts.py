"""Token counts of documents in flat token files that have no index.

A flat file holds token ids one after the other; an end-of-document id closes each document. Files are
scanned in blocks of equal size, each by any task, with one vectorised search for the separator. What a
block can't know (how many documents began before it, where its first document began) comes from a prefix
scan over one summary row per block, in two levels, so that no window holds more than `GROUP` blocks of a
file or one row for each group.

Empty documents count 0 tokens. Tokens after the last separator of a file are a document that is not
closed (`closed` false). Files without bytes give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableviews.llm.shared import NULL_ID, column, filesystem, new_folder, order_of, sliced, stored, texts_of
from tableviews.llm.tokens import encoder

# The id that closes a document: the vocabulary's end-of-text token, which no text yields.
SEPARATOR = 49407
BLOCK_BYTES = 4 << 20
GROUP = 1024


def write_flat_files(docs: DataFrame, *, separator: int = SEPARATOR, vocabulary: str | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Flat token files of whole texts, one for each input partition, without moving a text.

    Returns (files, ids): files has file, folder, path, n_bytes, width; ids has file, doc_no, doc_id, the order
    in which documents were written. The files of failed attempts are never listed.
    """
    folder = folder or new_folder(docs.sparkSession, "flat-tokens")
    ids_schema = pa.schema([("file", pa.int32()), ("doc_no", pa.int64()), ("doc", pa.int64()), ("path", pa.string()), ("n_bytes", pa.int64()), ("width", pa.int32())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, plain_specials=True)
        end = np.array([separator], encode.dtype).tobytes()
        system, base = filesystem(folder)
        file, n, size, out = TaskContext.get().partitionId(), 0, 0, None
        path = f"{base}/flat-{file:05d}-{uuid.uuid4().hex[:12]}.bin"
        for whole in batches:
            for batch in sliced(whole, 256):
                out = out or system.open_output_stream(path, compression=None)
                raw = end.join([*encode(texts_of(batch)), b""])
                out.write(raw)
                size += len(raw)
                rows = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, file), pa.int32()), pa.array(np.arange(n, n + rows)), column(batch, "doc"), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32())],
                    schema=ids_schema,
                )
                n += rows
        if out is not None:
            out.close()
            # the file's own row
            yield pa.RecordBatch.from_pylist([{"file": file, "doc_no": None, "doc": None, "path": path, "n_bytes": size, "width": encode.width}], ids_schema)

    rows = docs.select(order_of().alias("doc"), F.col("text").cast("string").alias("text")).mapInArrow(write, "file int, doc_no long, doc long, path string, n_bytes long, width int")
    written = stored(rows)
    files = written.filter(F.col("path").isNotNull()).select("file", F.lit(folder).alias("folder"), "path", "n_bytes", "width")
    ids = written.filter(F.col("path").isNull()).select("file", "doc_no", F.nullif(F.col("doc"), F.lit(NULL_ID)).alias("doc_id"))
    return files, ids


def scan_blocks(files: DataFrame, *, separator: int = SEPARATOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block: first token, number of tokens, separators found and where (8-byte positions in the file)."""
    schema = pa.schema([("file", pa.int32()), ("block", pa.int64()), ("end", pa.int64()), ("n_seps", pa.int64()), ("last_sep", pa.int64()), ("seps", pa.binary())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with filesystem(row["folder"])[0].open_input_file(row["path"]) as file:
                    at = row["block"] * block_bytes
                    ids = np.frombuffer(file.read_at(min(block_bytes, row["n_bytes"] - at), at), f"<u{row['width']}")
                first = at // row["width"]
                seps = np.flatnonzero(ids == separator) + first
                found = {"file": row["file"], "block": row["block"], "end": first + len(ids), "n_seps": len(seps), "last_sep": int(seps[-1]) if len(seps) else None, "seps": seps.astype("<i8").tobytes()}
                yield pa.RecordBatch.from_pylist([found], schema)

    blocks = files.filter("n_bytes > 0").withColumn("block", F.explode(F.expr(f"sequence(0L, (n_bytes - 1) div {block_bytes}L)")))
    spread = 8 * files.sparkSession.sparkContext.defaultParallelism
    return blocks.repartition(spread, "path", "block").mapInArrow(scan, "file int, block long, end long, n_seps long, last_sep long, seps binary")


def stitched(blocks: DataFrame) -> DataFrame:
    """Add to each block the documents closed before it and the place of the last separator before it."""
    grouped = blocks.withColumn("grp", F.expr(f"block div {GROUP}"))
    totals = grouped.groupBy("file", "grp").agg(F.sum("n_seps").alias("g_seps"), F.max("last_sep").alias("g_last"), F.max("block").alias("g_block"))
    above = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    totals = totals.select("file", "grp", F.sum("g_seps").over(above).alias("g_before"), F.max("g_last").over(above).alias("g_prev"), F.max("g_block").over(whole).alias("final_block"))
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        grouped.withColumn("in_before", F.sum("n_seps").over(inside))
        .withColumn("in_prev", F.max("last_sep").over(inside))
        .join(totals, ["file", "grp"])
        .select(
            "file",
            "seps",
            "end",
            (F.coalesce("in_before", F.lit(0)) + F.coalesce("g_before", F.lit(0))).alias("before"),
            F.coalesce("in_prev", "g_prev", F.lit(-1)).alias("prev"),
            (F.col("block") == F.col("final_block")).alias("final"),
        )
    )


def document_counts(files: DataFrame, **options) -> DataFrame:
    """One row for each document of the files: file, doc_no, start (token of the file), n_tokens without the separator, closed."""
    schema = pa.schema([("file", pa.int32()), ("doc_no", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("closed", pa.bool_())])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seps = np.frombuffer(row["seps"], "<i8")
                starts = np.concatenate([[row["prev"]], seps[:-1]]) + 1 if len(seps) else seps
                counts, closed = seps - starts, np.ones(len(seps), bool)
                after = int(seps[-1]) + 1 if len(seps) else row["prev"] + 1
                if row["final"] and after < row["end"]:
                    starts, counts, closed = np.append(starts, after), np.append(counts, row["end"] - after), np.append(closed, False)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["file"]), pa.int32()), pa.array(np.arange(row["before"], row["before"] + n)), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(closed)], schema=schema
                )

    return stitched(stored(scan_blocks(files, **options))).mapInArrow(rows, "file int, doc_no long, start long, n_tokens long, closed boolean")


def token_counts(docs: DataFrame, *, separator: int = SEPARATOR, vocabulary: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write flat files of the documents and count each document's tokens by the separator scan."""
    files, ids = write_flat_files(docs, separator=separator, vocabulary=vocabulary)
    return document_counts(files, separator=separator, block_bytes=block_bytes).join(ids, ["file", "doc_no"]).select("doc_id", "n_tokens", "file", "doc_no", "start")
