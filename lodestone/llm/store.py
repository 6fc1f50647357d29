"""The shared folder: written tables that cut lineage, and files that all executors can fetch."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of this machine, which only a local master can read."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="lodestone-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: survives lost executors, has no lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go now rather than at the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Remove a table that ``written`` made, once nothing reads it any more."""
    remove(df.sparkSession, df._written_at)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """Write one small driver-built file through the cluster's file system."""
    at, fs = _file_system(spark, path)
    out = fs.create(at, True)
    try:
        out.write(data)
    finally:
        out.close()
    return path


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies directly in a folder; nothing where there is none."""
    at, fs = _file_system(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
