"""Session settings and the shared folder used for checkpoints and exports."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where a later operator then needs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_LOCAL: list[tempfile.TemporaryDirectory] = []
_DUE: set[str] = set()

TASK_BYTES = 128 * 1024 * 1024
COMPILED_BYTES = 8000  # Fixed value: the longest method that HotSpot compiles.


def sized_for(input_bytes: int) -> dict[str, str]:
    """Settings for a cluster run over so much input.

    Enough shuffle partitions that each holds about 128 MiB if everything were
    shuffled; adaptive execution merges those that turn out smaller.
    """
    return {
        "spark.sql.shuffle.partitions": str(max(200, -(-input_bytes // TASK_BYTES))),
        "spark.sql.files.maxPartitionBytes": str(TASK_BYTES),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
    }


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job relies on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Write wide tables of long expressions with code that the JVM compiles.

    HotSpot interprets a method of over 8,000 bytes however often it runs, and a stage is one
    method. Under this setting Spark cuts such a stage into a method per expression.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, str(COMPILED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def build_session(app_name: str = "querytrail", master: str | None = None,
                  settings: dict[str, str] | None = None) -> SparkSession:
    """A configured session; cluster settings come from the submit command."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (settings or {}).items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where that setting is absent, a local master gets a temporary folder that goes with the
    process; on a cluster it is an error, as executors would write to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} "
                         "share; intermediate tables are written there")
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="querytrail-"))
    return _LOCAL[0].name


def own_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/querytrail-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own folder, which goes when the process ends."""
    folder = own_folder(spark)
    if folder not in _DUE:
        _DUE.add(folder)
        atexit.register(drop_folder, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables, in whatever store it is."""
    context = spark.sparkContext
    if context._jvm is None:
        return
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    _DUE.discard(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it is planned with fewer.

    For the raw columns of a scan that go through heavy expressions: a file of one row group
    is read by one task. A scan that has enough partitions stays as it is, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read that.

    For frames that several passes read, each a part of the columns. Lost executors read it
    again, and its size in bytes is known to the planner.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
