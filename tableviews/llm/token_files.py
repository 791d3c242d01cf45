"""Token-ID files of independent zstandard frames with a trailing seek table.

File format, little-endian throughout:

* one zstandard frame for each document, in order: its ids as unsigned integers of 2 or 4 bytes;
* a skippable frame with the width of an id (1 byte) and the document ids (8 bytes each; -2**63 for null);
* a skippable frame with the seek table: for each document frame the compressed size, the decompressed
  size and a checksum (lowest 4 bytes of the xxh64 of the decompressed bytes), then the footer with the
  number of frames, a descriptor and the closing magic number.

A reader opens the end of the file, finds the frames of the documents it wants and reads only these.

Null texts are empty, an empty text has only the end id, rows that repeat are written each time (in the
order of their texts), other columns are left out, and an empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableviews.llm.shared import NULL_ID, column, filesystem, new_folder, order_of, sliced, stored, texts_of
from tableviews.llm.tokens import encoder

# Fixed values of the seekable container of zstandard frames.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FILES = "part int, seq int, path string, n_docs long, n_tokens long, n_bytes long"


class FrameWriter:
    """Writes one file; documents go to it one by one."""

    def __init__(self, out, width: int, level: int = 1):
        self.out, self.width = out, width
        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.seek, self.ids = bytearray(), bytearray()
        self.n_bytes = self.n_tokens = self.n_docs = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        frame = self.press.compress(ids)
        self.out.write(frame)
        self.seek += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.ids += struct.pack("<q", doc_id)
        self.n_bytes += len(frame)
        self.n_tokens += len(ids) // self.width
        self.n_docs += 1

    def close(self) -> None:
        body = bytes([self.width]) + bytes(self.ids)
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(body)) + body)
        tail = struct.pack("<IBI", self.n_docs, CHECKSUM_FLAG, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(self.seek) + len(tail)) + bytes(self.seek) + tail)
        self.out.close()


class FrameReader:
    """Random access to the documents of a file by their place in it."""

    def __init__(self, system, path: str):
        self.file = system.open_input_file(path)
        size = self.file.size()
        n_docs, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table with checksums")
        at = size - 9 - 12 * n_docs
        self.table = np.frombuffer(self.file.read_at(12 * n_docs, at), "<u4").reshape(n_docs, 3)
        body = self.file.read_at(1 + 8 * n_docs, at - 8 - 1 - 8 * n_docs)
        self.width = body[0]
        self.doc_ids = np.frombuffer(body[1:], "<i8")
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        self.press = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _ids(self, k: int, frame: bytes) -> np.ndarray:
        raw = self.press.decompress(frame)
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"checksum of frame {k} does not match")
        return np.frombuffer(raw, f"<u{self.width}")

    def read(self, k: int) -> np.ndarray:
        """The ids of the k-th document; only its frame is read and decompressed."""
        return self._ids(k, self.file.read_at(int(self.table[k, 0]), int(self.at[k])))

    def read_all(self, chunk: int = 1 << 22) -> Iterator[np.ndarray]:
        """The ids of all documents in order, in reads of about `chunk` bytes."""
        k = 0
        while k < len(self):
            end = max(k + 1, int(np.searchsorted(self.at, self.at[k] + chunk, "right")) - 1)
            raw = self.file.read_at(int(self.at[end] - self.at[k]), int(self.at[k]))
            for j in range(k, end):
                a = int(self.at[j] - self.at[k])
                yield self._ids(j, raw[a : a + int(self.table[j, 0])])
            k = end


def write_token_files(
    docs: DataFrame, *, end_id: int = 2, vocabulary: str | None = None, docs_per_file: int = 8192, file_bytes: int = 256 << 20, folder: str | None = None
) -> DataFrame:
    """Encode documents and write them in ascending id order; one row for each file.

    Rows are ranged by id, so a file holds a range of ids; (part, seq) orders the files. Each task attempt
    writes files of its own names; only those of the attempt that succeeded are in the result, which is
    stored, so lost executors cost a task and never leave a half file in use.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    shards = max(1, -(-docs.count() // docs_per_file))
    ordered = docs.select(order_of().alias("doc"), F.col("text").cast("string").alias("text")).repartitionByRange(shards, "doc").sortWithinPartitions("doc", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([end_id], encode.dtype).tobytes()
        system, base = filesystem(folder)
        part, attempt, done, writer, path = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], [], None, ""

        def closed() -> None:
            writer.close()
            done.append((part, len(done), path, writer.n_docs, writer.n_tokens, writer.n_bytes))

        for whole in batches:
            for batch in sliced(whole, 256):
                for doc, ids in zip(column(batch, "doc").to_pylist(), encode(texts_of(batch)), strict=True):
                    if writer is None:
                        path = f"{base}/part-{part:05d}-{len(done):04d}-{attempt}.zst"
                        writer = FrameWriter(system.open_output_stream(path, compression=None), encode.width)
                    writer.add(doc, ids + end)
                    if writer.n_bytes >= file_bytes:
                        closed()
                        writer = None
        if writer is not None:
            closed()
        names = ["part", "seq", "path", "n_docs", "n_tokens", "n_bytes"]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(names, row, strict=True)) for row in done],
            pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]),
        )

    return stored(ordered.mapInArrow(write, FILES)).withColumn("folder", F.lit(folder))


def file_starts(files: DataFrame) -> DataFrame:
    """The number of ids before each file. The window has one row for each file, not for each document."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 4-byte integers)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = FrameReader(filesystem(row["folder"])[0], row["path"])
                at, out = row["base"], []
                for doc, ids in zip(reader.doc_ids.tolist(), reader.read_all(), strict=True):
                    out.append((None if doc == NULL_ID else doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                for k in range(0, len(out), 20_000):
                    part = list(zip(*out[k : k + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(part, schema, strict=True)], schema=schema)

    spark = files.sparkSession
    spread = max(1, min(files.count(), 8 * spark.sparkContext.defaultParallelism))
    return file_starts(files).select("folder", "path", "base").repartition(spread, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_rows(docs: DataFrame, **options) -> DataFrame:
    """Write the token files of all documents and read them back."""
    return read_token_files(write_token_files(docs, **options))
