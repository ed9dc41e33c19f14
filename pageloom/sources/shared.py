"""Tables written on the way: in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="pageloom-checkpoints-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A local session that names none gets one of its own;
    on a cluster that would be another folder on every machine, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or _own_dir()).rstrip("/")


@functools.cache
def _made_dir(spark: SparkSession, root: str) -> str:
    folder = f"{root}/pageloom-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def run_dir(spark: SparkSession) -> str:
    """The folder in the shared one for what this session writes on the way; removed when the driver ends."""
    return _made_dir(spark, shared_dir(spark))


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already; the folder then stays for the cluster's own cleaning
        pass


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor never reruns what made it."""
    path = f"{run_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the folder that materialize wrote for df; nothing may read it afterwards."""
    files = df.inputFiles()
    if files:
        _remove(df.sparkSession, files[0].rsplit("/", 1)[0])
