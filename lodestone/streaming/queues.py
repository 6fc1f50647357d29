"""Bounded state over streams: the union of file events until a flush is due, and queues that evict their oldest items.

What happens at an event is said once, by ``Union`` and ``Queue``, whose state is bounded whatever comes. The streams
hold that state with ``transformWithState`` (it needs the RocksDB state store), so it survives restarts; the batch forms
replay a table in the order of its keys and times, one row after the other, without collecting a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds between flushes at least, and from the first event to its flush at least; paths of a targeted scan.
INTERVAL, SETTLE, PATHS = 10_000, 2_000, 128
#: A queue of clips by items and bytes; events of containers kept.
CLIPS, CLIP_BYTES, EVENTS = 16, 32 << 20, 200

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """The state store that ``transformWithState`` needs."""
    for k, v in STORE.items():
        spark.conf.set(k, v)
    return spark


@dataclass
class Union:
    """Changed paths of one root since the last flush; more than ``most`` or a dropped event mean a full scan."""

    most: int = PATHS
    paths: set[str] = field(default_factory=set)
    full: bool = False
    due: int | None = None
    flushed: int | None = None

    def add(self, at: int, path: str | None, dropped: bool) -> None:
        if not self.full and not dropped and path is not None:
            self.paths.add(path)
        if dropped or path is None or len(self.paths) > self.most:
            self.full = True
            self.paths.clear()
        if self.due is None:
            since = INTERVAL if self.flushed is None else at - self.flushed
            self.due = at + max(SETTLE, INTERVAL - since)

    def flush(self) -> tuple[int, bool, list[str]]:
        """(time, full scan or not, paths to scan), and nothing is due then."""
        out = (self.due, self.full, sorted(self.paths))
        self.flushed, self.due, self.full, self.paths = self.due, None, False, set()
        return out


@dataclass
class Queue:
    """The newest items within a number and a sum of bytes; an item alone above ``largest`` is refused."""

    count: int
    most_bytes: int
    largest: int
    items: list[tuple[int, int, str]] = field(default_factory=list)

    def push(self, at: int, size: int, item: str) -> None:
        if size > self.largest:
            return
        used = sum(s for _, s, _ in self.items)
        while self.items and (len(self.items) >= self.count or used + size > self.most_bytes):
            used -= self.items.pop(0)[1]
        self.items.append((at, size, item))


FLUSHES = "root string, at long, full boolean, paths array<string>"
ITEMS = "key string, place int, at long, size long, item string"


class _UnionState(StatefulProcessor):
    """Paths in a map, the rest in one value; a timer of processing time flushes."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "held boolean")
        self.rest = handle.getValueState("rest", "full boolean, due long, flushed long")

    def _load(self) -> Union:
        full, due, flushed = self.rest.get() if self.rest.exists() else (False, None, None)
        return Union(self.most, {p for (p,) in self.paths.keys()} if self.paths.exists() else set(), full, due, flushed)

    def _keep(self, u: Union, before: set[str]) -> None:
        if not u.paths:
            self.paths.clear()
        for p in u.paths - before:
            self.paths.updateValue((p,), (True,))
        self.rest.update((u.full, u.due, u.flushed))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now, u = timerValues.getCurrentProcessingTimeInMs(), self._load()
        before, waiting = set(u.paths), u.due
        for frame in rows:
            for path, dropped in zip(frame["path"], frame["dropped"], strict=True):
                u.add(now, path, bool(dropped))
        self._keep(u, before)
        if u.due is not None and waiting is None:
            self.handle.registerTimer(u.due)
        yield from ()  # what is due comes with the timer

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        u = self._load()
        if u.due is None:
            return
        at, full, paths = u.flush()
        self._keep(u, set())
        yield pd.DataFrame({"root": [key[0]], "at": [at], "full": [full], "paths": [paths]})

    def close(self) -> None:
        pass


class _QueueState(StatefulProcessor):
    """Items in a list that is rewritten when they change; they also go after their time to live."""

    def __init__(self, count: int, most_bytes: int, largest: int, ttl_ms: int | None):
        self.bounds, self.ttl_ms = (count, most_bytes, largest), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "at long, size long, item string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        q = Queue(*self.bounds, [tuple(r) for r in self.items.get()] if self.items.exists() else [])
        for frame in rows:
            # in the order of time inside a micro-batch, as its rows may come in any
            for at, size, item in sorted(zip(frame["at"], frame["size"], frame["item"], strict=True)):
                q.push(int(at), int(size), item)
        if q.items:
            self.items.put(q.items)
        yield pd.DataFrame([(key[0], i, *x) for i, x in enumerate(q.items, 1)], columns=["key", "place", "at", "size", "item"])

    def close(self) -> None:
        pass


def file_event_stream(events: DataFrame, most: int = PATHS) -> DataFrame:
    """FLUSHES of a stream events(root, path, dropped), each when it is due by the clock of the cluster."""
    return events.select("root", "path", "dropped").groupBy("root").transformWithStateInPandas(_UnionState(most), FLUSHES, "Append", "ProcessingTime")


def queue_stream(events: DataFrame, count: int = CLIPS, most_bytes: int = CLIP_BYTES, largest: int = CLIP_BYTES, ttl_ms: int | None = None) -> DataFrame:
    """The queue of each key after each micro-batch of events(key, at, size, item) that touches it."""
    return events.select("key", "at", "size", "item").groupBy("key").transformWithStateInPandas(_QueueState(count, most_bytes, largest, ttl_ms), ITEMS, "Update", "ProcessingTime" if ttl_ms else "None")


def _replayed(rows: DataFrame, order: list[str], step, schema: str) -> DataFrame:
    return rows.repartition(order[0]).sortWithinPartitions(*order).mapInArrow(step, schema)


def file_event_flushes(events: DataFrame, most: int = PATHS) -> DataFrame:
    """FLUSHES of a table events(root, at in ms, path, dropped), as the stream would have made them at those times."""
    schema = pa.schema([("root", pa.string()), ("at", pa.int64()), ("full", pa.bool_()), ("paths", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, u = None, Union(most)
        for batch in batches:
            out = []
            for r, at, path, dropped in zip(*[batch.column(c).to_pylist() for c in ("root", "at", "path", "dropped")], strict=True):
                if r != root:
                    if u.due is not None:
                        out.append((root, *u.flush()))
                    root, u = r, Union(most)
                elif u.due is not None and at >= u.due:
                    out.append((root, *u.flush()))
                u.add(at, path, bool(dropped))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o, strict=True)) for o in out], schema)
        if u.due is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (root, *u.flush()), strict=True))], schema)

    rows = events.where("root is not null and at is not null").select("root", F.col("at").cast("long").alias("at"), "path", "dropped")
    return _replayed(rows, ["root", "at", "path", "dropped"], run, FLUSHES)


def queues(events: DataFrame, count: int = CLIPS, most_bytes: int = CLIP_BYTES, largest: int = CLIP_BYTES) -> DataFrame:
    """The queue of each key after all of a table events(key, at, size, item)."""
    schema = pa.schema([("key", pa.string()), ("place", pa.int32()), ("at", pa.int64()), ("size", pa.int64()), ("item", pa.string())])

    def rows_of(key: str | None, q: Queue) -> list[dict]:
        return [dict(zip(schema.names, (key, i, *x), strict=True)) for i, x in enumerate(q.items, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, q = None, Queue(count, most_bytes, largest)
        for batch in batches:
            out = []
            for k, *event in zip(*[batch.column(c).to_pylist() for c in ("key", "at", "size", "item")], strict=True):
                if k != key:
                    out += rows_of(key, q)
                    key, q = k, Queue(count, most_bytes, largest)
                q.push(*event)
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist(rows_of(key, q), schema)

    rows = events.where("key is not null and at is not null and size is not null").select("key", F.col("at").cast("long").alias("at"), F.col("size").cast("long").alias("size"), "item")
    return _replayed(rows, ["key", "at", "size", "item"], run, ITEMS)
