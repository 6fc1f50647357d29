"""Fixed-size sketches built by all tasks and merged without any growing state.

A sketch is cut into SLICES; each task emits its slices once, a streaming merge adds (or ors) them,
and the driver receives exactly one array of the agreed size, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 16
#: Cells below which a sketch is merged at one level.
SMALL = 1 << 14


def emit(sketch: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(slice, bytes) rows of a task's sketch; slices that are all zero are left out."""
    for i, part in enumerate(np.split(sketch, SLICES)):
        if part.any():
            yield i, part.tobytes()


def _merger(dtype: str, width: int, how: str) -> Callable:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("slice").to_pylist(), batch.column("data")):
                part = np.frombuffer(data.as_buffer(), dtype)
                into = held.setdefault(i, np.zeros(width // SLICES, dtype))
                np.add(into, part, out=into) if how == "add" else np.bitwise_or(into, part, out=into)
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "data"])

    return merge


def merged(rows: DataFrame, dtype: str, width: int, how: str) -> np.ndarray:
    """The whole sketch from rows (slice int, data binary). ``width`` is fixed by the caller.

    Two levels keep a merging task's share near the square root of the number of tasks; a sketch of a few
    kilobytes needs one.
    """
    merge, rows = _merger(dtype, width, how), rows.select("slice", "data")
    if width < SMALL:
        second = rows.repartition(2, "slice")
    else:
        first = rows.repartition(SLICES * 4, "slice", F.pmod(F.xxhash64("data"), F.lit(8)))
        second = first.mapInArrow(merge, "slice int, data binary").repartition(SLICES, "slice")
    out = np.zeros(width, dtype)
    step = width // SLICES
    # at most one row a slice: the sketch's own fixed size
    for row in second.mapInArrow(merge, "slice int, data binary").collect():
        part = out[row.slice * step : (row.slice + 1) * step]
        np.copyto(part, np.frombuffer(bytes(row.data), dtype))
    return out


class Bloom:
    """Membership filter of a fixed number of bits; false positives only cost work."""

    def __init__(self, bits_log2: int, words: np.ndarray | None = None):
        self.log2 = bits_log2
        self.words = np.zeros(1 << (bits_log2 - 3), np.uint8) if words is None else words

    def _at(self, keys: np.ndarray) -> list[np.ndarray]:
        keys = keys.view(np.uint64)
        mixed = keys * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        return [(mixed >> np.uint64(64 - self.log2)), (mixed << np.uint64(30)) >> np.uint64(64 - self.log2)]

    def add(self, keys: np.ndarray) -> None:
        for at in self._at(keys):
            np.bitwise_or.at(self.words, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self._at(keys):
            found &= (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def bloom_of(df: DataFrame, column: str, bits_log2: int) -> Bloom:
    """Bloom filter over a bigint column, made by the executors."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Bloom(bits_log2)
        for batch in batches:
            keys = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(keys):
                mine.add(np.unique(keys))
        rows = list(emit(mine.words))
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "data"])

    rows = df.select(column).mapInArrow(build, "slice int, data binary")
    return Bloom(bits_log2, merged(rows, "uint8", 1 << (bits_log2 - 3), "or"))
