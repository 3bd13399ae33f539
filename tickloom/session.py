"""Spark session defaults and shared-folder helpers."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}
#: Bytes a task reads at most, of files and of a shuffle: a larger input has more tasks, not larger ones.  Smaller settings of the cluster stay.
SIZE_CONF = {"spark.sql.files.maxPartitionBytes": 8 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 32 << 20}
#: Shuffle partitions before Spark merges small ones, enough for some 16 GB a shuffle.
PARTITIONS_CONF, PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 512
#: Drops the shuffle files of a finished execution at once, not when the driver happens to collect its garbage.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application.

    Functions that run in Python workers import it there; a cluster that installed the wheel
    finds its own copy first.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root, packed = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, f"{root.name}/{path.relative_to(root)}")
        place = Path(tempfile.mkdtemp(prefix=f"{root.name}-")) / f"{root.name}.zip"
        place.write_bytes(packed.getvalue())
        context.addPyFile(str(place))  # the driver serves the file; executors fetch it
        _shipped.add(context.applicationId)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator relies on (UTC clock, AQE)."""
    ship(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, most in SIZE_CONF.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    if int(spark.conf.get(PARTITIONS_CONF, None) or 0) < PARTITIONS:
        spark.conf.set(PARTITIONS_CONF, str(PARTITIONS))
    return spark


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([a-z]?)(?:i?b)?", size.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tickloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Small row groups let readers split a file between tasks even where few tasks wrote it.
ROW_GROUP = 8 * 1024 * 1024


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out to all shuffle partitions before each of them multiplies.

    A small table of spans or series would otherwise be merged into one task, which then
    explodes all of them alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`.

    Executors write there and others read it, so on a cluster nothing else will do and a missing
    setting raises.  In local mode driver and executors are one process: a scratch folder serves.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Used where a wide result feeds several later passes: without it each pass would
    recompute everything before it.  Unlike a checkpointed RDD, the Parquet table still
    prunes columns and pushes filters, and it outlives the executors that wrote it.  The plan of a write
    runs once, so its shuffle files go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by).option("compression", "zstd").option("parquet.block.size", ROW_GROUP)
    kept = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP_CONF) if kept is None else spark.conf.set(CLEANUP_CONF, kept)
    return spark.read.schema(df.schema).parquet(path)
