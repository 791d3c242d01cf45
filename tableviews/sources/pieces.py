"""Files whose records span lines, or stand in one list, read by many tasks.

Spark's text reader cuts a file at a separator that ends every record (and stands elsewhere too), and splits the file
into blocks.  Whether a piece ends a record depends on what came before it: a quoted part may be open, and brackets may
be.  So each piece is measured for both beginnings, inside and outside a quoted part, and the blocks are put together:

1. one pass gives a short row for each block: for both beginnings how it ends, how the depth of brackets has changed,
   and at how many pieces a record would end for each depth that the block may have begun with;
2. the rows of a file, in order, tell how each block really begins and how many records stand before it;
3. a second pass joins the pieces of each record.  Only records that cross a block's border are put together by a
   shuffle; all others stay where they were read.

The blocks have to be the same in both passes, so their size is pinned meanwhile and the records are stored.  What the
driver holds and sends to the tasks is one row of numbers for each block of a file.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tableviews.session import ship_package, stored

# For a beginning outside and one inside a quoted part: whether the piece ends inside one, and the change of depth.
Measure = Callable[[str], tuple[tuple[int, int], tuple[int, int]]]

SUMMARY = "file string, start long, begins int, ends int, change long, closing map<long,long>"
# Text that a task hands back at once.
BATCH_CHARS = 1 << 23
UNITS = "file string, start long, nr long, ord long, whole boolean, rest boolean, text string"


@dataclass(frozen=True)
class Format:
    """How records are told apart in a text: the separator behind each piece, and the depth at which a record ends."""

    separator: str
    measure: Measure
    depth: int
    keep_separator: bool
    # the depth after the file's last piece, to which a separator is reckoned
    last_depth: int


@contextmanager
def fixed_blocks(spark: SparkSession, block_bytes: int | None) -> Iterator[None]:
    """The same file blocks for every job inside, whatever the number of executors is by then."""
    wanted = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    if block_bytes:
        wanted["spark.sql.files.maxPartitionBytes"] = str(block_bytes)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _pieces(spark: SparkSession, path: str, form: Format) -> DataFrame:
    text = spark.read.option("lineSep", form.separator).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """Runs of pieces of one block; a block may come in several runs, one after the other."""
    for batch in batches:
        files, starts, values = (batch.column(batch.schema.get_field_index(name)) for name in ("file", "start", "value"))
        begin = 0
        while begin < batch.num_rows:
            file, start = files[begin].as_py(), starts[begin].as_py()
            same = pc.and_(pc.equal(files, files[begin]), pc.equal(starts, starts[begin])).slice(begin)
            other = pc.index(same, False).as_py()
            end = batch.num_rows if other < 0 else begin + other
            yield file, start, values.slice(begin, end - begin).to_pylist()
            begin = end


def _summaries(form: Format) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [field.split()[0] for field in SUMMARY.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.map_(pa.int64(), pa.int64())]

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, state, change, closing = None, [0, 1], [0, 0], [Counter(), Counter()]

        def close() -> None:
            if at is not None:
                done.extend((*at, s, state[s], change[s], list(closing[s].items())) for s in (0, 1))

        for file, start, values in _by_block(batches):
            if (file, start) != at:
                close()
                at, state, change, closing = (file, start), [0, 1], [0, 0], [Counter(), Counter()]
            for value in values:
                measured = form.measure(value)
                for s in (0, 1):
                    state[s], step = measured[state[s]]
                    change[s] += step
                    if not state[s]:
                        closing[s][change[s]] += 1
        close()
        columns = zip(*done, strict=True) if done else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return summed


@dataclass
class Begin:
    """How a block begins: inside a quoted part, depth, records of its file and of all files before, and what it is in its file."""

    inside: int
    depth: int
    nr: int
    ord: int
    first: bool
    last: bool = False


def _beginnings(summary: list, form: Format, broken: Callable[[str], str]) -> dict[tuple[str, int], Begin]:
    """The beginning of each block, from the summaries of all blocks; a file that ends amid a record is an error."""
    of = {(row["file"], row["start"], row["begins"]): row for row in summary}
    begins: dict[tuple[str, int], Begin] = {}
    file, inside, depth, nr, order = None, 0, 0, 0, 0

    def finish() -> None:
        if file is not None:
            begins[block].last = True
            if inside or depth != form.last_depth:
                raise ValueError(broken(file))

    block = None
    for name, start in sorted({(row["file"], row["start"]) for row in summary}):
        if name != file:
            finish()
            file, inside, depth, nr = name, 0, 0, 0
        first = block is None or block[0] != name
        block = (name, start)
        begins[block] = Begin(inside, depth, nr, order, first)
        row = of[name, start, inside]
        ended = dict(row["closing"]).get(form.depth - depth, 0)
        inside, depth, nr, order = row["ends"], depth + row["change"], nr + ended, order + ended
    finish()
    return begins


def _joined(form: Format, shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records, or parts of records, of each block."""
    names = [field.split()[0] for field in UNITS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = shared.value
        done: list[tuple] = []
        chars = 0
        at, begin, waiting = None, None, []
        inside = depth = nr = order = 0
        whole = True

        def leave() -> None:
            # what waits goes on in the next block, or is what the file ends with
            if waiting:
                text = form.separator.join(waiting)
                done.append((*at, nr, order, False, begin.last, text if begin.last else text + form.separator))

        for file, start, values in _by_block(batches):
            if (file, start) != at:
                leave()
                at, waiting = (file, start), []
                begin = begins[at]
                inside, depth, nr, order = begin.inside, begin.depth, begin.nr, begin.ord
                # a record ends before the block if it begins outside quotes at the depth of records
                whole = begin.first or not inside and depth == form.depth
            for value in values:
                waiting.append(value)
                inside, step = form.measure(value)[inside]
                depth += step
                if not inside and depth == form.depth:
                    text = form.separator.join(waiting)
                    done.append((*at, nr, order, whole, False, text + form.separator if form.keep_separator or not whole else text))
                    waiting, whole, nr, order = [], True, nr + 1, order + 1
                    chars += len(text)
                    if chars >= BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                        done.clear()
                        chars = 0
        leave()
        columns = zip(*done, strict=True) if done else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    return joined


def read_records(spark: SparkSession, path: str, form: Format, broken: Callable[[str], str], block_bytes: int | None = None) -> DataFrame:
    """(file, nr, ord, rest, text) of all records below a path, stored.

    ord goes on from file to file in the order of names, nr begins at 0 in each file.  What stands behind a file's last
    record comes as one more row with ``rest``.
    """
    ship_package(spark)
    with fixed_blocks(spark, block_bytes):
        summary = _pieces(spark, path, form).mapInArrow(_summaries(form), SUMMARY).collect()
        shared = spark.sparkContext.broadcast(_beginnings(summary, form, broken))
        units = stored(_pieces(spark, path, form).mapInArrow(_joined(form, shared), UNITS))
    whole = units.filter("whole").select("file", "nr", "ord", "rest", "text")
    # a record that crosses borders has one part for each block
    parts = units.filter("NOT whole").groupBy("file", "nr", "ord").agg(
        F.bool_or("rest").alias("rest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "").alias("text")
    )
    glued = parts if form.keep_separator else parts.withColumn("text", F.when(F.col("text").endswith(form.separator), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text")))
    return whole.unionByName(glued)
