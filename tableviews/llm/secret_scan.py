"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger is a table of
(blob, rule, rule_version) with the spans found, empty ones included; a scan reads only blobs for which the
ledger lacks a rule at its present version, each once however many paths and versions hold it. Findings
are then joined back to all paths.

Null texts are empty. Rows that repeat are kept, with the same findings. Other columns are left out. An empty
table gives an empty result, and writes nothing to the ledger.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tableviews.llm.shared import column, new_folder, stored, texts_of

# The patterns of the base rules, fixed values.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Rules of this project beyond the base.
FORGE = re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")

Spans = list[tuple[int, int]]


def assignments(text: str) -> Spans:
    """A name of a secret, a sign of assignment and a value of 6 characters or more."""
    lower = text.lower()
    if not any(word in lower for word in ASSIGN_WORDS):
        return []
    return [m.span() for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]


def access_keys(text: str) -> Spans:
    return [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []


def hex_runs(text: str) -> Spans:
    """Whole runs of lower-case hexadecimal digits; a run is found at its first digit, so its length is that of the match."""
    return [m.span() for m in HEX.finditer(text)]


def forge_tokens(text: str) -> Spans:
    return [m.span() for m in FORGE.finditer(text)] if "gh" in text else []


def key_blocks(text: str) -> Spans:
    return [m.span() for m in KEY_BLOCK.finditer(text)] if "-----BEGIN" in text else []


# Rules in the order in which spans with one start are listed: name, version, function, whether it is a base rule.
RULES: list[tuple[str, int, Callable[[str], Spans], bool]] = [
    ("assign", 1, assignments, True),
    ("access", 1, access_keys, True),
    ("hex", 1, hex_runs, True),
    ("forge", 1, forge_tokens, False),
    ("keyblock", 1, key_blocks, False),
]

LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:int,end:int>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LEDGER)


def blobs_of(versions: DataFrame) -> DataFrame:
    """Add the address of each version's text."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def scan_unseen(addressed: DataFrame, path: str, rules=None) -> DataFrame:
    """Scan what the ledger at `path` lacks, add it there, and return the ledger's rows for the present rules.

    Which row stands for a blob is settled on addresses alone; then the texts of these rows are scanned where they
    are dealt. A run that fails leaves nothing in the ledger, as Spark commits the files of a write together.
    """
    rules = rules or RULES
    spark = addressed.sparkSession
    wanted = {name: version for name, version, _, _ in rules}
    ledger = read_ledger(spark, path)
    current = F.lit(False)
    for name, version in wanted.items():
        current = current | ((F.col("rule") == name) & (F.col("rule_version") == version))
    known = ledger.filter(current).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    # a blob's row: the smallest row tag
    tagged = addressed.withColumn("row_tag", F.xxhash64("key"))
    chosen = tagged.groupBy("blob").agg(F.min("row_tag").alias("row_tag")).join(known, "blob", "left").filter(F.coalesce(F.size("seen"), F.lit(0)) < len(wanted))
    schema = pa.schema([("blob", pa.string()), ("rule", pa.string()), ("rule_version", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, done = [], set()
            for blob, text, seen in zip(column(batch, "blob").to_pylist(), texts_of(batch), column(batch, "seen").to_pylist(), strict=True):
                if blob in done:
                    continue
                done.add(blob)
                for name, version, find, _ in rules:
                    if name not in (seen or ()):
                        out.append({"blob": blob, "rule": name, "rule_version": version, "spans": [{"start": a, "end": b} for a, b in find(text)]})
            yield pa.RecordBatch.from_pylist(out, schema)

    unseen = tagged.select("blob", "row_tag", "text").join(chosen, ["blob", "row_tag"])
    unseen.mapInArrow(scan, LEDGER).write.mode("append").parquet(path)
    return read_ledger(spark, path).filter(current)


def findings(ledger_rows: DataFrame) -> DataFrame:
    """One row for each blob with spans: all of them by start, and by rule where starts are equal. Rows written twice count once."""
    order = F.create_map(*[F.lit(x) for k, (name, *_) in enumerate(RULES) for x in (name, k)])
    span = F.explode("spans").alias("span")
    rows = ledger_rows.filter(F.size("spans") > 0).select("blob", "rule", span)
    entry = F.struct(F.col("span.start").alias("start"), F.coalesce(order[F.col("rule")], F.lit(99)).alias("place"), F.col("span.end").alias("end"), F.col("rule").alias("rule"))
    return rows.groupBy("blob").agg(F.array_sort(F.collect_set(entry)).alias("found"))


def scan_versions(versions: DataFrame, *, keys: list[str], text: str = "text", ledger: str | None = None, rules=None) -> DataFrame:
    """Findings of every version of every path: the keys, blob and found (an array, empty if there is nothing).

    ledger: where the ledger lies from run to run; a new one in the shared folder by default.
    """
    ledger = ledger or f"{new_folder(versions.sparkSession, 'secret-ledger')}/blobs"
    rows = blobs_of(versions.select(*keys, F.col(text).alias("text"))).withColumn("key", F.struct(*keys))
    found = findings(scan_unseen(rows, ledger, rules))
    addresses = stored(rows.select(*keys, "blob"))
    empty = F.array().cast(found.schema["found"].dataType)
    return addresses.join(found, "blob", "left").withColumn("found", F.coalesce("found", empty))


def secret_rows(docs: DataFrame, **options) -> DataFrame:
    """The digest of each document's findings: counts by base rule, hash of base spans, all spans."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    base = [name for name, _, _, is_base in RULES if is_base]
    count = lambda rule: F.size(F.filter("found", lambda s: s["rule"] == rule)).cast("long").alias(f"n_{rule}")
    found = scan_versions(docs, keys=["doc_id"], **options)
    return found.select("doc_id", *[count(rule) for rule in base], F.sha2(listed(F.filter("found", lambda s: s["rule"].isin(base))), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def spans_by_hand(text: str) -> str:
    """What `spans` holds for one text; for tests."""
    found = [(a, k, b, name) for k, (name, _, find, _) in enumerate(RULES) for a, b in find(text)]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def base_digest_by_hand(spans: str) -> str:
    base = {name for name, _, _, is_base in RULES if is_base}
    return hashlib.sha256(",".join(s for s in spans.split(",") if s.split(":")[0] in base).encode()).hexdigest()
