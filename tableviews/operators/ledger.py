"""A ledger of replies: every prompt is sent once, and what was answered outlives a run that stops.

Prompts are known by the hash of their text, so equal prompts of any number of requests, runs and views share one reply.
A call sends only prompts without a reply, in batches that are dealt by that hash.  A finished batch is a file of its own,
named after its prompts and moved into place when it is whole: a task that runs again, because its executor was lost or a
later batch failed, meets the file and does not send the batch again.  (Two attempts at one time, as speculative execution
makes them, may both send a batch; their files have one name.)  A prompt for which the function gives None, or a blank
text, gets no reply and is sent again by the next call.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileType
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tableviews.functions.cells import is_blank
from tableviews.session import filesystem, ship_package

BATCH_PROMPTS = 64
REPLIES = "prompt_key string, text string, wave string"
_SCHEMA = pa.schema([(field.split()[0], pa.string()) for field in REPLIES.split(", ")])


class Sent(NamedTuple):
    """What a call did: prompts given to the function, prompts of batches that were found finished, prompts still without a reply."""

    sent: int
    found: int
    silent: int


def prompt_key(prompt: Column) -> Column:
    """The name of a prompt: the hash of its text."""
    return F.sha2(prompt.cast("binary"), 256)


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """(prompt_key, text, wave) of all replies below a folder."""
    system, path = filesystem(folder)
    system.create_dir(path)
    return spark.read.schema(REPLIES).parquet(folder)


def pending(requests: DataFrame, folder: str) -> DataFrame:
    """(prompt_key, prompt) of the different prompts that have no reply yet."""
    asked = requests.filter(F.col("prompt").isNotNull()).select(prompt_key(F.col("prompt")).alias("prompt_key"), "prompt")
    known = replies(requests.sparkSession, folder).select("prompt_key").distinct()
    return asked.groupBy("prompt_key").agg(F.min("prompt").alias("prompt")).join(known, "prompt_key", "left_anti")


def send(requests: DataFrame, folder: str, fn: Callable[[list[str]], list[str | None]], wave: str = "", batch_prompts: int = BATCH_PROMPTS) -> Sent:
    """Send what has no reply to ``fn``, a batch of prompts at a time, and put the replies down below ``folder``.

    ``wave`` is a note on the replies of this call.
    """
    spark = requests.sparkSession
    ship_package(spark)
    open_prompts = pending(requests, folder)
    n = open_prompts.count()
    if not n:
        return Sent(0, 0, 0)
    batches = -(-n // batch_prompts)
    # a prompt's batch depends on the number of open prompts only, so a task that runs again has the same batches
    dealt = open_prompts.withColumn("batch", F.pmod(F.xxhash64("prompt_key"), F.lit(batches)).cast("int")).repartition("batch").sortWithinPartitions("batch", "prompt_key")

    def finish(keys: list[str], prompts: list[str]) -> tuple[int, int, int]:
        system, path = filesystem(folder)
        name = hashlib.sha256(" ".join(keys).encode()).hexdigest()
        place = f"{path}/{name}.parquet"
        if system.get_file_info(place).type == FileType.File:
            return 0, len(keys), 0
        texts = fn(prompts)
        if len(texts) != len(prompts):
            raise ValueError(f"{len(prompts)} prompts got {len(texts)} replies")
        told = [(key, text, wave) for key, text in zip(keys, texts, strict=True) if text is not None and text.strip()]
        if told:
            # readers pass over names that begin with an underscore
            new = f"{path}/_{name}-{uuid.uuid4().hex}"
            pq.write_table(pa.table([list(c) for c in zip(*told, strict=True)], schema=_SCHEMA), new, filesystem=system)
            system.move(new, place)
        return len(keys), 0, len(keys) - len(told)

    def run(incoming: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, prompts, done = None, [], [], []
        for part in incoming:
            for batch, key, prompt in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("batch", "prompt_key", "prompt")), strict=True):
                if batch != at and keys:
                    done.append(finish(keys, prompts))
                    keys, prompts = [], []
                at = batch
                keys.append(key)
                prompts.append(prompt)
        if keys:
            done.append(finish(keys, prompts))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(3)], names=["sent", "found", "silent"])

    total = dealt.mapInArrow(run, "sent long, found long, silent long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in Sent._fields]).first()
    return Sent(*total)


def answered(requests: DataFrame, folder: str) -> DataFrame:
    """(request_id, text, wave) of the requests whose prompt has a reply, as `exchange.attach_replies` takes them."""
    # a prompt has one reply, unless two attempts sent its batch in different company
    single = replies(requests.sparkSession, folder).filter(~is_blank(F.col("text"))).groupBy("prompt_key").agg(F.min(F.struct("text", "wave")).alias("reply"))
    keyed = requests.select("request_id", prompt_key(F.col("prompt")).alias("prompt_key"))
    return keyed.join(single, "prompt_key").select("request_id", "reply.text", "reply.wave")
