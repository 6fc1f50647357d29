"""Keyed state over streams: frecency, clip history, incremental catalog, busy folders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.usage import HALF_LIFE_DAYS
from lodestone.operators.catalog_state import upsert


def frecency_stream(events: DataFrame, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """Updates (id, score, updated) of events(id, at in seconds): one decayed score a key, in update mode.

    The score is kept as of the newest use, so late uses only add what would be left of them.
    """
    half = half_life_days * 86400.0

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score, updated = state.get if state.exists else (0.0, 0)
        for f in frames:
            at = f["at"].to_numpy(dtype="float64")
            newest = max(updated, int(at.max())) if score else int(at.max())
            score = score * 0.5 ** ((newest - updated) / half) + float((0.5 ** ((newest - at) / half)).sum()) if half > 0 else score + len(at)
            updated = newest
        state.update((score, updated))
        yield pd.DataFrame({"id": [key[0]], "score": [score], "updated": [updated]})

    kind = events.schema["id"].dataType.simpleString()
    return events.select("id", "at").groupBy("id").applyInPandasWithState(step, f"id {kind}, score double, updated long", "score double, updated long", "update", GroupStateTimeout.NoTimeout)


def clip_stream(events: DataFrame, keep: int) -> DataFrame:
    """Updates (user_id, clips, newest first) of events(user_id, at, clip): repeated clips move to the front.

    State holds at most ``keep`` digests and times a user.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        for f in frames:
            for clip, at in zip(f["clip"], f["at"]):
                held[clip] = max(int(at), held.get(clip, int(at)))
        # eviction waits for the batch's end, so order inside a batch does not matter
        best = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:keep]
        state.update(([c for c, _ in best], [t for _, t in best]))
        yield pd.DataFrame({"user_id": [key[0]], "clips": [[c for c, _ in best]]})

    kind = events.schema["user_id"].dataType.simpleString()
    return events.select("user_id", "at", "clip").groupBy("user_id").applyInPandasWithState(step, f"user_id {kind}, clips array<string>", "clips array<string>, ats array<long>", "update", GroupStateTimeout.NoTimeout)


def busy_folder_stream(events: DataFrame, least: int = 20) -> DataFrame:
    """events(folder, ts) in sliding windows of five minutes each ten seconds; late data by watermark."""
    w = F.window("ts", "5 minutes", "10 seconds")
    return events.withWatermark("ts", "1 minute").groupBy(w.alias("w"), "folder").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("w.end").alias("at"), "folder", "n")


class Catalog:
    """A document table in versions, one folder each; a batch that was applied is never applied again.

    The version's name is the batch id, so a retried micro-batch overwrites its own unfinished folder or
    finds it finished; a batch older than the newest version is superseded and cannot write.
    """

    SCHEMA = "document_id long, identity string, path string, body string, bytes long, revision long, seen long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(conf)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v{versions[-1]:012d}")

    def apply(self, changes: DataFrame, batch_id: int) -> bool:
        """Upsert a batch; False if it is superseded."""
        versions = self.versions()
        if versions and batch_id <= versions[-1]:
            return False
        upsert(self.read(), changes, batch_id).write.mode("overwrite").parquet(f"{self.path}/v{batch_id:012d}")
        return True

    def stream(self, changes: DataFrame, checkpoint: str):
        """Apply a stream of changes, everything available now."""
        return changes.writeStream.foreachBatch(lambda df, n: self.apply(df, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def needs_full_scan(paths: int, dropped: bool, most: int = 128) -> bool:
    """Whether a batch of file events is too large or too incomplete for a targeted scan."""
    return dropped or paths > most


def flush_delay(since_last: float) -> float:
    """Seconds until collected file events are applied."""
    return max(2.0, 10.0 - since_last)


def retry_delay(attempt: int) -> float:
    """Backoff of a failed pass in seconds: doubles from 30, at most 900."""
    return min(900.0, 30.0 * 2 ** min(max(attempt, 0), 5))


EVENT_ACTIONS = "start stop die kill pause unpause restart destroy create".split()


def container_events(lines: DataFrame) -> DataFrame:
    """Allowed actions of JSON event lines(value)."""
    j = F.from_json("value", T.StructType([T.StructField("Action", T.StringType()), T.StructField("id", T.StringType()), T.StructField("time", T.LongType())]))
    return lines.select(j.alias("e")).where(F.col("e.Action").isin(EVENT_ACTIONS) & F.col("e.id").rlike("^[0-9a-f]{12,64}$")).select(F.col("e.id").alias("id"), F.col("e.Action").alias("action"), F.col("e.time").alias("t"))
