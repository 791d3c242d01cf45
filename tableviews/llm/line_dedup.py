"""Line deduplication with a sharded minimal perfect hash.

A line's key is the line without white space at both ends and with A-Z in lower case; keys of at least
`min_chars` code points that stand in two documents or more are kept only in the smallest document.

1. Each task hashes its documents' lines to 128 bits; (hash, document, line number) is stored.
2. The hashes of two documents or more are the index's members. They are dealt to shards; each shard is one
   minimal perfect hash over its members with two arrays by slot, the other half of the hash as fingerprint and
   the smallest document, written as one file in the shared folder.
3. Stored line hashes go to their shards (salted, as one line can be a third of all) and probe the arrays: the
   slot's fingerprint tells members from others, the smallest document tells which lines go. No line is joined.
4. The numbers of lines to drop go back to their documents.

Lines are split at \\n only. Null texts are one empty line. Null ids come before all others. Rows that repeat
an id count as one document, each with its own lines. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableviews.llm.shared import batches_by_key, column, filesystem, new_folder, order_of, stored, texts_of

# White space at the ends of a key, a fixed value: \x20 and \x09-\x0D.
BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
KEYS_PER_SHARD = 500_000
SALTS = 64


def line_keys(text: str) -> list[bytes]:
    """The key of every line of a text, as UTF-8."""
    return [line.strip(BLANKS) for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least)


def line_hashes(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc, tag, line_no) for every line with a key of at least min_chars code points."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("line_no", pa.int32())])

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5 = hashlib.md5
        for batch in batches:
            digests, numbers, lengths = [], [], []
            for text in texts_of(batch):
                found = [(k, md5(key, usedforsecurity=False).digest()) for k, key in enumerate(line_keys(text)) if _long_enough(key, min_chars)]
                numbers += [k for k, _ in found]
                digests += [d for _, d in found]
                lengths.append(len(found))
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            docs, tags = (np.repeat(np.asarray(column(batch, c)), lengths) for c in ("doc", "tag"))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((both[:, 0], both[:, 1], docs, tags, np.array(numbers, np.int32)), schema.types, strict=True)], schema=schema)

    return rows.mapInArrow(hashed, "h1 long, h2 long, doc long, tag long, line_no int")


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit mix of the keys, another one at each level."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash by levels: at each level, keys that have a cell alone take it, the rest go on."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, start = [], 0
        for cells in levels:
            self.ranks.append(start + np.concatenate([[0], np.cumsum(cells, dtype=np.int64)]))
            start = int(self.ranks[-1][-1])
        self.size = start

    @classmethod
    def build(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        """keys: distinct 64-bit integers."""
        levels, rest = [], keys
        while len(rest):
            n = max(2, int(room * len(rest)))
            cell = (_mixed(rest, len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(cell, minlength=n) == 1
            levels.append(alone)
            rest = rest[~alone[cell]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that are no members, any slot for the others."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, cells in enumerate(self.levels):
            if not len(rest):
                break
            cell = (_mixed(keys[rest], level) % np.uint64(len(cells))).astype(np.int64)
            hit = cells[cell]
            out[rest[hit]] = self.ranks[level][cell[hit]]
            rest = rest[~hit]
        return out

    def packed(self) -> list[bytes]:
        return [np.packbits(cells).tobytes() for cells in self.levels]

    @classmethod
    def unpacked(cls, sizes: list[int], bits: list[bytes]) -> PerfectHash:
        return cls([np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool) for n, raw in zip(sizes, bits, strict=True)])


class LineShard:
    """One shard of the index: the hash and its arrays of fingerprints, line counts (up to 255) and smallest documents."""

    FIELDS = pa.schema([("sizes", pa.list_(pa.int64())), ("bits", pa.list_(pa.binary())), ("fingerprints", pa.binary()), ("counts", pa.binary()), ("firsts", pa.binary())])

    def __init__(self, mph: PerfectHash, fingerprints: np.ndarray, counts: np.ndarray, firsts: np.ndarray):
        self.mph, self.fingerprints, self.counts, self.firsts = mph, fingerprints, counts, firsts

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> LineShard:
        mph = PerfectHash.build(h1)
        slot = mph.slots(h1)
        out = [np.empty(len(h1), t) for t in (np.int64, np.uint8, np.int64)]
        for array, values in zip(out, (h2, np.minimum(counts, 255), firsts), strict=True):
            array[slot] = values
        return cls(mph, *out)

    def write(self, out) -> None:
        row = {"sizes": [len(x) for x in self.mph.levels], "bits": self.mph.packed(), "fingerprints": self.fingerprints.tobytes(), "counts": self.counts.tobytes(), "firsts": self.firsts.tobytes()}
        with pa.ipc.new_file(out, self.FIELDS) as file:
            file.write_batch(pa.RecordBatch.from_pylist([row], self.FIELDS))

    @classmethod
    def read(cls, system, path: str) -> LineShard:
        with system.open_input_file(path) as file:
            row = pa.ipc.open_file(file).get_batch(0).to_pylist()[0]
        return cls(PerfectHash.unpacked(row["sizes"], row["bits"]), np.frombuffer(row["fingerprints"], np.int64), np.frombuffer(row["counts"], np.uint8), np.frombuffer(row["firsts"], np.int64))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each line hash whether it is a member, and its smallest document."""
        if not self.mph.size:
            return np.zeros(len(h1), bool), np.zeros(len(h1), np.int64)
        slot = self.mph.slots(h1)
        safe = np.maximum(slot, 0)
        return (slot >= 0) & (self.fingerprints[safe] == h2), self.firsts[safe]


def build_index(hashes: DataFrame, folder: str, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """Write the shards of the hashes that two documents or more hold. Returns (shard, path) and the number of shards.

    Slots follow the first half of a hash, fingerprints are the second half. Two members of one shard with equal
    first halves (one case in some 10**4 runs over 10**10 members) end the job with an error, not a wrong result.
    """
    members = stored(hashes.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("count")).filter("first < last"))
    shards = max(1, -(-members.count() // keys_per_shard))
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string())])

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        for table in batches_by_key(batches, ["shard"]):
            shard = np.asarray(table["shard"])
            for number in np.unique(shard).tolist():
                h1, h2, count, first = (np.asarray(table[c])[shard == number] for c in ("h1", "h2", "count", "first"))
                if len(np.unique(h1)) != len(h1):
                    raise ValueError("two lines share the first half of a 128-bit hash; choose another hash")
                path = f"{base}/shard-{number:06d}-{uuid.uuid4().hex[:12]}.arrow"
                with system.open_output_stream(path, compression=None) as out:
                    LineShard.build(h1, h2, count, first).write(out)
                yield pa.RecordBatch.from_pylist([{"shard": number, "path": path}], schema)

    dealt = members.withColumn("shard", shard_of(shards)).repartition(shards, "shard").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(build, "shard int, path string")), shards


def shard_of(shards: int):
    return F.pmod(F.col("h2"), F.lit(shards)).cast("int")


def probe_index(hashes: DataFrame, index: DataFrame, shards: int, folder: str) -> DataFrame:
    """(doc, tag, line_no) of the lines to drop."""
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("line_no", pa.int32())])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path, shard = filesystem(folder)[0], None, None
        for batch in batches:
            paths = column(batch, "path").dictionary_encode()
            codes = np.asarray(paths.indices)
            for code in np.unique(codes).tolist():
                if paths.dictionary[code].as_py() != path:
                    path = paths.dictionary[code].as_py()
                    shard = LineShard.read(system, path)
                part = batch.filter(pa.array(codes == code))
                member, first = shard.probe(np.asarray(column(part, "h1")), np.asarray(column(part, "h2")))
                yield part.filter(pa.array(member & (first < np.asarray(column(part, "doc"))))).select(schema.names)

    spark = hashes.sparkSession
    probes = hashes.withColumn("shard", shard_of(shards)).join(index, "shard")
    parts = max(SALTS, shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = probes.withColumn("salt", F.pmod(F.xxhash64("doc", "line_no"), F.lit(SALTS))).repartition(parts, "shard", "salt").sortWithinPartitions("shard")
    return salted.mapInArrow(probe, "doc long, tag long, line_no int")


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """Each document's text without the repeated lines: doc_id, kept, n_lines, n_dropped, kept_sha256."""
    folder = new_folder(docs.sparkSession, "line-index")
    rows = docs.select("doc_id", order_of().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tag", F.xxhash64("text"))
    hashes = stored(line_hashes(rows.select("doc", "tag", "text"), min_chars))
    index, shards = build_index(hashes, folder, keys_per_shard)
    drops = probe_index(hashes, index, shards, folder).groupBy("doc", "tag").agg(F.collect_set("line_no").alias("drops"))
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped, digests = [], [], [], []
            for text, numbers in zip(texts_of(batch), column(batch, "drops").to_pylist(), strict=True):
                lines = text.split("\n")
                gone = set(numbers or ())
                kept.append("\n".join([line for k, line in enumerate(lines) if k not in gone]) if gone else text)
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
                digests.append(hashlib.sha256(kept[-1].encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests, pa.string())], schema=schema)

    return rows.join(drops, ["doc", "tag"], "left").select("doc_id", "text", "drops").mapInArrow(cut, "doc_id long, kept string, n_lines long, n_dropped long, kept_sha256 string")
