"""Tables in the shared folder that cut lineage between rounds of joins, and the few file operations around them."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of this machine, which only a local master can read."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("at", "file://" + tempfile.mkdtemp(prefix="lodestone-"))


def fresh(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as written Parquet: lost executors read it again instead of computing it again."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def let_go(*frames: DataFrame) -> None:
    for df in frames:
        delete(df.sparkSession, df._saved_at)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def there(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    at, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


#: Seconds after which a claim whose writer never finished is void.
VOID_AFTER = 600


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole under a name that nobody has; False if another writer has or claims the name.

    Exclusive creation of a claim decides between writers, and the text is complete before the name exists. It needs a
    file system that creates exclusively, as HDFS and local disks do.
    """
    at, fs = _fs(spark, path)
    claim, aside = _fs(spark, f"{path}.claim")[0], _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")[0]
    if fs.exists(at):
        return False
    if fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > VOID_AFTER:
        fs.delete(claim, False)
    out = fs.create(aside, False)
    try:
        out.write(text.encode())
    finally:
        out.close()
    try:
        fs.create(claim, False).close()
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "AlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    # the name may have been taken, and its claim removed, since the first look
    won = not fs.exists(at) and bool(fs.rename(aside, at))
    fs.delete(claim, False)
    if not won:
        fs.delete(aside, False)
    return won
