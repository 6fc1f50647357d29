"""Folder walks as rounds of Spark jobs: each round lists the folders that the last one found and let through.

An excluded folder is never opened, and of files only names and sizes are read until ``with_content`` is asked for
those that are kept. All executors must see the folder under the same path (a shared mount).
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.operators.filters import collapsed_paths, excluded, indexable

#: Bounds of a scan and of a list of changed paths (fixed values).
MAX_DEPTH, MAX_ENTRIES, MAX_CHANGED = 64, 10_000_000, 128
LISTED = "root string, path string, depth int, kind string, bytes long, modified_ns long, changed_ns long"
#: Kinds of rows that say a scan did not see everything.
HOLES = ("unreadable", "too deep", "limit")
_FIELDS = pa.schema([("root", pa.string()), ("path", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("bytes", pa.int64()), ("modified_ns", pa.int64()), ("changed_ns", pa.int64())])
ROWS, READ_BYTES = 8192, 16 << 20


def _row(root: str, path: str, depth: int, s: os.stat_result, folder: bool) -> tuple:
    return root, path, depth, "folder" if folder else "file", s.st_size, s.st_mtime_ns, s.st_ctime_ns


def _entries(root: str, path: str, depth: int) -> Iterator[tuple]:
    """What lies right below a folder; a path that is a file gives itself. Links, other devices and special files are passed over."""
    hole = lambda kind, at=path: (root, at, depth, kind, None, None, None)
    try:
        own = os.lstat(path)
        if stat.S_ISREG(own.st_mode):
            yield _row(root, path, depth, own, False)
        if not stat.S_ISDIR(own.st_mode):
            return
        with os.scandir(path) as found:
            for entry in found:
                try:
                    entry.name.encode()
                    s = entry.stat(follow_symlinks=False)
                except (OSError, UnicodeEncodeError):
                    yield hole("unreadable", os.path.join(path, entry.name.encode(errors="replace").decode()))
                    continue
                folder = stat.S_ISDIR(s.st_mode)
                if folder and s.st_dev == own.st_dev or stat.S_ISREG(s.st_mode):
                    yield _row(root, os.path.join(path, entry.name), depth + 1, s, folder)
    except FileNotFoundError:
        yield hole("gone")
    except OSError:
        yield hole("unreadable")


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    full = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)], schema=_FIELDS)
    for batch in batches:
        for r in batch.to_pylist():
            for row in _entries(r["root"], r["path"], r["depth"]):
                rows.append(row)
                if len(rows) >= ROWS:
                    yield full()
                    rows = []
    if rows:
        yield full()


def _inside() -> Column:
    """The part of a path below its root, which exclusion rules judge."""
    return F.expr("substring(path, char_length(root) + 1)")


def walk(spark: SparkSession, roots: list[str], targets: list[str] | None = None, depth: int = MAX_DEPTH, most: int = MAX_ENTRIES) -> DataFrame:
    """(root, path, depth, kind, bytes, modified_ns, changed_ns) of supported files below the roots, and of ``HOLES``.

    With targets (at most 128 changed paths), only those are looked at: files by themselves, folders in full, one
    below another once, a missing one as kind ``gone``; targets outside all roots or excluded give no rows.
    Folders deeper than ``depth`` give a row ``too deep``; a walk that has seen ``most`` entries stops after its round
    and says ``limit``. A walk without holes is complete. Links are not followed, other devices not entered.
    """
    bases = [r.rstrip("/") or "/" for r in roots]
    if targets is None:
        start = [(b, b, 0) for b in collapsed_paths(bases)] if bases else []
    else:
        if len(targets) > MAX_CHANGED:
            raise ValueError(f"at most {MAX_CHANGED} changed paths; scan the root instead")
        below = [(max((b for b in bases if t == b or t.startswith(b.rstrip("/") + "/")), key=len, default=None), t) for t in collapsed_paths(targets)]
        start = [(b, t, t[len(b) :].strip("/").count("/") + 1 if t != b else 0) for b, t in below if b is not None]
    path, seen, at = scratch.fresh(spark, "walk"), 0, 0
    frontier = spark.createDataFrame(start, "root string, path string, depth int").where(~excluded(_inside()))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        # a number of partitions that is said stays: a round is small in bytes, not in work
        frontier.repartition(spread, "path").mapInArrow(_listed, LISTED).write.parquet(f"{path}/round={at}")
        now = spark.read.schema(LISTED).parquet(f"{path}/round={at}")
        folders = now.where("kind = 'folder'").where(~excluded(_inside()))
        totals = now.agg(F.count("*").alias("n")).first()
        seen, deeper = seen + totals.n, folders.where(F.col("depth") < depth)
        if deeper.isEmpty():
            break
        if seen >= most:
            deeper.select("root", "path", "depth", F.lit("limit").alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("bytes", "modified_ns", "changed_ns")]).write.parquet(f"{path}/round={at + 1}")
            break
        frontier, at = deeper.select("root", "path", "depth"), at + 1
    rows = spark.read.schema(LISTED).parquet(f"{path}/round=*").where(~excluded(_inside()))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "folder") & (F.col("depth") >= depth), "too deep").otherwise(F.col("kind")))
    return rows.where(F.col("kind").isin("gone", *HOLES) | ((F.col("kind") == "file") & indexable(F.col("path"))))


def is_complete(listing: DataFrame) -> bool:
    """Whether what is not listed is known to be gone."""
    return listing.where(F.col("kind").isin(*HOLES)).isEmpty()


def _contents(most: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, contents, held = 0, [], 0
            pack = lambda: pa.record_batch([*batch.slice(first, len(contents)).columns, pa.array(contents, pa.binary())], [*batch.schema.names, "content"])
            for path in batch.column("path").to_pylist():
                try:
                    with open(path, "rb") as f:
                        content = f.read() if most is None else f.read(most)
                except OSError:
                    content = None
                contents.append(content)
                held += len(content or b"")
                if held >= READ_BYTES:
                    yield pack()
                    first, contents, held = first + len(contents), [], 0
            if contents:
                yield pack()

    return run


def with_content(listing: DataFrame, most: int | None = None) -> DataFrame:
    """(path, modified_ns, bytes, content) of the listed files, at most the first ``most`` bytes of each; null where one can't be read any more.

    ``sources.files.documents`` takes these rows; it looks at no more than ``MAX_TEXT + 1`` bytes.
    """
    return listing.where("kind = 'file'").select("path", "modified_ns", "bytes").mapInArrow(_contents(most), "path string, modified_ns long, bytes long, content binary")


def local_path(uri: str) -> str:
    """A ``file:`` URI as a path of the mount; other schemes can't be walked."""
    if re.match(r"^[a-z][a-z0-9+.-]+:", uri) and not uri.startswith("file:"):
        raise ValueError(f"not a mounted folder: {uri}")
    return re.sub(r"^file:/*(?=/)", "", uri)
