"""Similarity join on word n-grams by chosen paths.

Two documents are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8. Words are
runs of letters, digits and underscores in lower case; a text of fewer words has one shingle of all of them, a text
without words has none and no link.

1. Documents with equal sets are one class at once, and only its smallest document goes on, with the number of copies.
2. A set is split down a path: at each level a token shared by a bucket is sampled, as the set's minimum under one of
   64 random orders; which order comes next follows from the path so far. A bucket of up to `SMALL` sets is a leaf;
   larger ones are split again, down to `DEPTH` levels. A pair of similarity s stays together for d levels with
   probability s**d, so `runs_for` gives the number of independent runs for the target recall.
3. Leaves are compared by brute force: larger ones in blocks of chunks, so no task holds more than two chunks. A pair
   is dropped early only if its sizes rule out the similarity, or if its 64 minima agree in under
   `similarity - 4 * deviation` of the orders; a pair that shared a leaf in an earlier run was seen there.
4. The sets of what is left are read again from the texts and intersected exactly. A block gives the number of links
   of each set and a spanning forest of its links, so what leaves it is no longer than the block.
5. The forests' components are the classes.

Null texts are empty. Null ids come before all others. Rows that share an id, or have none, count as copies if their
texts are equal, and are documents of their own if they are not, in the order of their hashes; each row of the input
has its row in the result. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableviews.llm.components import components
from tableviews.llm.shared import WordHashes, batches_by_key, column, numbered, order_of, sliced, stored, text_tag, texts_of, with_ids

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
ORDERS = 64
DEPTH = 4
SMALL = 256
CHUNK = 256

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def runs_for(similarity: float = SIMILARITY, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Runs after which a pair at the bound has shared a leaf with probability `recall`, if every path goes to the depth."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of the n-word shingles, ascending."""
    if not len(words):
        return words
    n = min(n, len(words))
    value = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        value = (value ^ words[k : len(words) - n + 1 + k]) * _GOLD
        value ^= value >> np.uint64(29)
    return np.unique(value)


class Orders:
    """The random orders: the minimum of a set under each."""

    def __init__(self, n: int = ORDERS):
        draw = np.random.Generator(np.random.PCG64(20240607))
        self.a = draw.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 2**63, n, dtype=np.uint64)

    def minima(self, values: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max)
        for at in range(0, len(values), 4096):
            part = values[None, at : at + 4096] * self.a[:, None]
            part += self.b[:, None]
            np.minimum(best, part.min(axis=1), out=best)
        return best


def paths(minima: np.ndarray, runs: int, depth: int) -> np.ndarray:
    """The path of every set (row) at each level of each run, runs * depth columns."""
    n, orders = minima.shape
    out, rows = np.empty((n, runs * depth), np.uint64), np.arange(n)
    for run in range(runs):
        path = np.full(n, (run + 1) * 0x51_7C_C1_B7, np.uint64)
        order = np.full(n, run % orders)
        for level in range(depth):
            path = mixed(path * _GOLD ^ minima[rows, order])
            out[:, run * depth + level] = path
            # an order that no other run begins with
            order = ((path >> np.uint64(7)) % np.uint64(max(1, orders - runs))).astype(np.int64) + runs if orders > runs else order
    return out.view(np.int64)


def sketches(docs: DataFrame, runs: int, depth: int) -> DataFrame:
    """(doc, k1, k2, n, sig, paths) for documents with words: the key of the set, its size, 16 bits of each minimum, the paths."""
    schema = pa.schema([("doc", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("paths", pa.list_(pa.int64()))])

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, orders = WordHashes(), Orders()
        for whole in batches:
            for batch in sliced(whole, 256):
                sets = [shingle_set(words) for words in hashes(texts_of(batch))]
                full = [k for k, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                minima = np.array([orders.minima(sets[k]) for k in full])
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[k].tobytes()) for k in full), "<i8").reshape(-1, 2)
                marks = (mixed(minima) & np.uint64(0xFFFF)).astype("<u2")
                way = paths(minima, runs, depth)
                yield pa.RecordBatch.from_arrays(
                    [
                        column(batch, "doc").take(pa.array(full)),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.array([len(sets[k]) for k in full], pa.int32()),
                        pa.array([row.tobytes() for row in marks], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, way.size + 1, runs * depth), pa.int32()), pa.array(way.ravel())),
                    ],
                    schema=schema,
                )

    return docs.mapInArrow(sketch, "doc long, k1 long, k2 long, n int, sig binary, paths array<long>")


def leaves_of(sets: DataFrame, runs: int, depth: int, small: int = SMALL) -> DataFrame:
    """(rep, run, leaf, size) for all sets that share a leaf with another."""
    way = F.expr(f"slice(paths, run * {depth} + 1, {depth})")
    active = sets.select("rep", "paths", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).select("rep", "run", way.alias("way"))
    out = []
    for level in range(depth):
        step = active.withColumn("path", F.col("way")[level])
        # a table of its own: adaptive execution splits a hot path only where the join reads plain shuffles
        sizes = stored(step.groupBy("path").count().filter("count > 1").withColumnRenamed("count", "size"))
        live = stored(step.join(sizes, "path"))
        last = level == depth - 1
        done = live if last else live.filter(F.col("size") <= small)
        out.append(done.select("rep", "run", F.col("path").alias("leaf"), "size"))
        active = live.filter(F.col("size") > small).select("rep", "run", "way")
        if last or active.isEmpty():
            break
    found = out[0]
    for more in out[1:]:
        found = found.unionAll(more)
    return found


BLOCK = ["leaf", "lo", "hi"]


def blocks_of(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Deal the rows of each leaf to its blocks: all pairs of chunks, a chunk with itself included."""
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    dealt = rows.withColumn("chunks", chunks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("chunks", "other", "size")


def _groups(table: pa.Table) -> np.ndarray:
    """The end of the block of each row; rows are sorted by block."""
    n = table.num_rows
    change = np.zeros(n, bool)
    for key in BLOCK:
        values = np.asarray(table[key])
        change[1:] |= values[1:] != values[:-1]
    starts = np.concatenate([np.flatnonzero(change), [n]])
    return starts[np.searchsorted(starts, np.arange(n), "right")]


def _pairs(end: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a block, some at a time."""
    rows = np.arange(len(end))
    step, held, count = 1, [], 0
    while len(rows):
        rows = rows[rows + step < end[rows]]
        if len(rows):
            held.append((rows, rows + step))
            count += len(rows)
        if held and (count >= most or not len(rows)):
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, count = [], 0
        step += 1


class BlockRows:
    """Rows of whole blocks, and which of their pairs are new."""

    def __init__(self, table: pa.Table, runs: int):
        self.end = _groups(table)
        self.n, self.run, self.own = (np.asarray(table[c]) for c in ("n", "run", "own"))
        self.split = np.asarray(table["lo"]) != np.asarray(table["hi"])
        self.leaves = np.frombuffer(b"".join(table["leaves"].to_pylist()), "<i8").reshape(-1, runs)

    def new(self, i: np.ndarray, j: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.n[i], self.n[j]
        good = np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
        good &= ~self.split[i] | (self.own[i] != self.own[j])
        i, j = i[good], j[good]
        together = (self.leaves[i] == self.leaves[j]) & (self.leaves[i] != 0)
        together &= np.arange(self.leaves.shape[1])[None, :] < self.run[i][:, None]
        fresh = ~together.any(axis=1)
        return i[fresh], j[fresh]


def candidates(blocks: DataFrame, runs: int, similarity: float) -> DataFrame:
    """(leaf, lo, hi, rep) of the sets that have a possible link in a block."""
    schema = pa.schema([("leaf", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("rep", pa.int64())])
    least = similarity - 4 * math.sqrt(similarity * (1 - similarity) / ORDERS)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_by_key(batches, BLOCK):
            rows = BlockRows(table, runs)
            marks = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u2").reshape(table.num_rows, -1)
            wanted = np.zeros(table.num_rows, bool)
            for i, j in _pairs(rows.end):
                i, j = rows.new(i, j, similarity)
                close = (marks[i] == marks[j]).mean(axis=1) >= least if len(i) else np.zeros(0, bool)
                wanted[i[close]] = True
                wanted[j[close]] = True
            found = table.select(schema.names).filter(pa.array(wanted)).combine_chunks()
            yield from found.cast(schema).to_batches()

    return dealt_by_block(blocks).mapInArrow(search, "leaf long, lo int, hi int, rep long")


def dealt_by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "rep")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(rep, shingles) of the documents: the whole sets as sorted 8-byte hashes."""
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for batch in sliced(whole, 256):
                yield pa.RecordBatch.from_arrays([column(batch, "doc"), pa.array([shingle_set(w).tobytes() for w in hashes(texts_of(batch))], pa.binary())], schema=schema)

    return docs.mapInArrow(sets, "rep long, shingles binary")


def intersections(sets: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """The sizes of all intersections of the sets, by products of slices of their incidence matrix."""
    m = len(sets)
    if m == 2:
        return np.array([[0, (n := len(np.intersect1d(*sets, assume_unique=True)))], [n, 0]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.cumsum(np.bincount(place, minlength=len(tokens)) > 1) - 1
    keep = np.bincount(place, minlength=len(tokens))[place] > 1
    owner, cell = owner[keep], shared[place[keep]]
    order = np.argsort(cell, kind="stable")
    owner, cell = owner[order], cell[order]
    out = np.zeros((m, m), np.int64)
    for at in range(0, int(cell[-1]) + 1 if len(cell) else 0, width):
        a, b = np.searchsorted(cell, [at, at + width])
        x = np.zeros((m, width), np.float32)
        x[owner[a:b], cell[a:b] - at] = 1
        out += (x @ x.T).astype(np.int64)
    return out


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two trees, taken in order."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for a, b in pairs:
        if (p := root(a)) != (q := root(b)):
            parent[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def links(blocks: DataFrame, runs: int, similarity: float) -> DataFrame:
    """(rep, links, other): the number of documents linked to a set in a block, and the links of the block's forest."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (part for batch in batches for part in sliced(batch, 256))
        for table in batches_by_key(small, BLOCK):
            table = table.combine_chunks()
            rows = BlockRows(table, runs)
            reps, copies = np.asarray(table["rep"]), np.asarray(table["copies"])
            count, edges = np.zeros(table.num_rows, np.int64), []
            start = 0
            while start < table.num_rows:
                end = int(rows.end[start])
                sets = [np.frombuffer(raw, "<u8") for raw in table["shingles"].slice(start, end - start).to_pylist()]
                common = intersections(sets)
                i, j = (x + start for x in np.triu_indices(end - start, 1))
                i, j = rows.new(i, j, similarity)
                both = common[i - start, j - start]
                linked = both >= similarity * (rows.n[i].astype(np.int64) + rows.n[j] - both) - 1e-9
                i, j = i[linked], j[linked]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                edges += _forest(list(zip(reps[i].tolist(), reps[j].tolist(), strict=True)))
                start = end
            has = np.flatnonzero(count)
            a, b = ([e[k] for e in edges] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(reps[has]), pa.array(a, pa.int64())]), pa.concat_arrays([pa.array(count[has]), pa.nulls(len(a), pa.int64())]), pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(b, pa.int64())])], schema=schema
            )

    return dealt_by_block(blocks).mapInArrow(verify, "rep long, links long, other long")


def classes(texts: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """(doc, class, n_copies, n_links) for each row of texts; rows of one doc have one text."""
    runs = runs_for(similarity, depth, recall)
    sketch = stored(sketches(texts, runs, depth))
    # a table of its own: adaptive execution splits a large group of copies only where the joins read plain shuffles
    sets = stored(sketch.groupBy("k1", "k2").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")))
    # merged at every size: there are about as many sets as documents
    of_set = sets.hint("merge")
    members = stored(sketch.select("doc", "k1", "k2").join(of_set, ["k1", "k2"]).select("doc", "rep", "copies"))
    chosen = stored(sketch.join(of_set, ["k1", "k2"]).filter("doc = rep").dropDuplicates(["rep"]).select("rep", "n", "copies", "sig", "paths"))

    leaves = stored(leaves_of(chosen, runs, depth, small))
    rows = leaves.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("run", "leaf", "size"))).alias("held"))
    full = chosen.drop("paths").join(rows, "rep").mapInArrow(_with_leaf_bytes(runs), "rep long, n int, copies long, sig binary, leaves binary, held array<struct<run:int,leaf:long,size:long>>")
    full = stored(full)
    one = F.explode("held").alias("at")
    spread = full.select("rep", "n", "sig", "leaves", one).select("rep", "n", "sig", "leaves", "at.*")
    wanted = stored(candidates(blocks_of(spread, chunk), runs, similarity))

    needed = wanted.select("rep").distinct()
    held = stored(shingle_sets(texts.join(needed.withColumnRenamed("rep", "doc"), "doc")).dropDuplicates(["rep"]))
    slim = full.select("rep", "n", "copies", "leaves", one).select("rep", "n", "copies", "leaves", "at.run", "at.leaf", "at.size")
    # the blocks again, for the sets that are wanted in them
    verified = stored(links(blocks_of(slim, chunk).join(wanted, [*BLOCK, "rep"]).join(held, "rep"), runs, similarity))

    roots = components(verified.filter("other IS NOT NULL").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    counts = verified.filter("links IS NOT NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    out = texts.select("doc").join(members.dropDuplicates(["doc"]), "doc", "left").join(roots, "rep", "left").join(counts, "rep", "left")
    return out.select(
        "doc",
        F.coalesce("root", "rep", "doc").alias("class"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )


def similar_classes(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest id of its class), n_copies (documents with its very set),
    n_links (documents linked to it, copies included)."""
    texts, pairs = numbered(docs)
    return with_ids(classes(texts, **options), pairs, doc_id="doc", class_id="class").select("doc_id", "class_id", "n_copies", "n_links")


def _with_leaf_bytes(runs: int):
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int32()), ("copies", pa.int64()), ("sig", pa.binary()), ("leaves", pa.binary()), ("held", pa.list_(pa.struct([("run", pa.int32()), ("leaf", pa.int64()), ("size", pa.int64())])))])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = column(batch, "held").cast(schema.field("held").type)
            at = held.value_lengths().to_numpy()
            flat = held.flatten()
            grid = np.zeros((batch.num_rows, runs), "<i8")
            grid[np.repeat(np.arange(batch.num_rows), at), np.asarray(flat.field("run"))] = np.asarray(flat.field("leaf"))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in ("rep", "n", "copies", "sig")], pa.array([r.tobytes() for r in grid], pa.binary()), held], schema=schema)

    return add


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the smallest of their class, with their own columns."""
    texts, pairs = numbered(docs)
    gone = classes(texts, **options).filter(F.col("doc") != F.col("class")).select("doc").distinct()
    # columns of gone are named by their table, as docs may have any names
    if pairs is None:
        gone = gone.select(F.col("doc").alias("__doc"))
        return docs.join(gone, order_of() == gone["__doc"], "left_anti")
    gone = pairs.join(gone, "doc", "left_semi").select(F.col("id").alias("__id"), F.col("tag").alias("__tag"))
    return docs.join(gone, (order_of() == gone["__id"]) & (text_tag() == gone["__tag"]), "left_anti")
