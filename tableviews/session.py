"""Session settings the operators rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings: skewed joins are split even when that costs an extra
# exchange, partitions are coalesced after a shuffle, times are read as UTC.
# A side is broadcast on its estimated size only below 1 MB, as estimates rest on
# compressed files; larger sides have to show their real size at run time.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tableviews")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one the session names, else, on a single machine, one below the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/intermediate"


def stored(df: DataFrame, folder: str | None = None, compression: str | None = None) -> DataFrame:
    """Write an intermediate result once and go on from its files, below ``folder`` or the shared folder.

    For results that several outputs are made of: they are computed once, their
    lineage ends here, and readers take only the columns they need.  Who names the
    folder removes it.  ``compression`` is Spark's own unless one is named.
    """
    path = f"{folder or checkpoint_folder(df.sparkSession)}/tableviews-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """Deal rows out to a number of partitions that the caller names; for sources of few splits with heavy work per row."""
    return df.repartition(partitions)


def filesystem(place: str):
    """The file system and the path inside it that a folder's address means."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(place)


def new_folder(spark: SparkSession, what: str) -> str:
    """The address of a new folder below the shared one, for files that tasks write and read."""
    place = f"{checkpoint_folder(spark)}/{what}-{uuid.uuid4().hex}"
    system, path = filesystem(place)
    system.create_dir(path)
    return place


def ship_package(spark: SparkSession) -> None:
    """Give the tasks of this session the package, once, for clusters where it is not installed."""
    import io
    import zipfile
    from pathlib import Path

    import tableviews

    context = spark.sparkContext
    if getattr(context, "tableviews_shipped", False):
        return
    root, buffer = Path(tableviews.__path__[0]), io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"tableviews/{file.relative_to(root)}")
    place = new_folder(spark, "package")
    system, path = filesystem(place)
    with system.open_output_stream(f"{path}/tableviews.zip", compression=None) as out:
        out.write(buffer.getvalue())
    context.addPyFile(f"{place}/tableviews.zip")
    context.tableviews_shipped = True
