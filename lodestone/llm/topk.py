"""Exact top-k inner products by block-at-a-time pruning.

Documents are vectors of whole numbers, their components the terms. They are sorted by a cell of a bounded k-means fit
and by closeness to its centre, and cut into shards (ranges of that order) of blocks (ranges of a shard). A block keeps
its forward index, a matrix, and the largest and smallest value of each term in it, so the sum of a query's term
maxima bounds every score in it. A query visits the blocks of a shard by falling bound and stops where bounds fall
below its k-th best; the queries of a batch that want the same block share one matrix product.

Two passes: a query first searches the shard of its own cell, which sets its k-th best; then it goes to all other shards
with that. Blocks and queries meet by shard in one sorted stream a task: a shard's blocks come first and are
held (bounded bytes), its queries stream by in bounded parts.

Products are exact: 32-bit floats where all sums stay below 2**24, doubles below 2**53, Python's integers beyond.

Cases: rows with a null id, a null vector or a null or non-finite component take no part; a missing component of a
shorter vector counts as 0; rows of one id are each other's own, and each such query row is answered by itself; scores
beyond 64 bits are cut to the ends of that range; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import store

#: Rows of a block, bytes of a shard's matrix, rows that the cells are fitted on at most, queries of a batch and of a part.
BLOCK_ROWS, SHARD_BYTES, SAMPLE, BATCH, PART = 64, 16 << 20, 16_384, 512, 262_144
CELLS = 64
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_BLOCK = "shard int, block int, cell int, n int, ids binary, matrix binary, high binary, low binary"


def whole_parts(v: Column, scale: int) -> Column:
    """floor(scale * x) of each component as doubles; null for a vector that takes no part."""
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    fine = F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    # doubles of 2**52 and more are whole already, and may lie beyond a long
    return F.when(fine, F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` doubles, shorter lists filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _narrow(m: np.ndarray) -> np.ndarray:
    """As 32-bit floats where they hold every value exactly."""
    small = m.astype(np.float32)
    return small if np.array_equal(small, m) else m


def _read(data: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * width * rows else np.float64).reshape(rows, width)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers as 64-bit integers."""
    most = math.sqrt(float((a.astype(np.float64) ** 2).sum(1).max(initial=0))) * math.sqrt(float((b.astype(np.float64) ** 2).sum(1).max(initial=0)))
    if most < 1 << 23:
        return (a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T).astype(np.int64)
    if most < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.array([[min(max(sum(x), _LEAST), _MOST) for x in zip(*[[p * q for q in col] for p, col in zip(r, exact(b).T, strict=True)], strict=True)] for r in exact(a)], np.int64).reshape(len(a), len(b))


def _fitted(rows: DataFrame, width: int, cells: int, sample: int) -> np.ndarray:
    """Unit centres of spherical k-means on at most ``sample`` rows, chosen by a hash of the id."""
    picked = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    v = _matrix(picked.column("v"), width)
    v = v / np.maximum(np.abs(v).max(1, initial=0), 1)[:, None]
    v = v / np.maximum(np.linalg.norm(v, axis=1), 1e-30)[:, None]
    centre = v[:: max(1, len(v) // cells)][:cells].copy()
    for _ in range(8):
        own = np.argmax(v @ centre.T, axis=1)
        for c in np.unique(own):
            total = v[own == c].sum(0)
            length = np.linalg.norm(total)
            if length:
                centre[c] = total / length
    return centre


@dataclass
class BlockIndex:
    """Blocks of all rows, on storage; ``first`` gives each cell the shard that its rows begin in or before."""

    blocks: DataFrame
    centre: np.ndarray
    width: int
    first: list[int]

    @staticmethod
    def built(vectors: DataFrame, block_rows: int = BLOCK_ROWS, shard_bytes: int = SHARD_BYTES, sample: int = SAMPLE, cells: int = CELLS) -> BlockIndex | None:
        """Index of vectors(vec_id, v); v are doubles of whole numbers, null for rows that take no part. None without rows."""
        rows = vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
        spark = rows.sparkSession
        n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
        if not n:
            return None
        centre = _fitted(rows, max(width, 1), cells, sample)
        width = max(width, 1)
        sent = spark.sparkContext.broadcast(centre)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near = _matrix(batch.column("v"), width) @ sent.value.T
                own = near.argmax(1) if len(near) else np.zeros(0, int)
                yield pa.record_batch([*batch.columns, pa.array(own.astype(np.int32)), pa.array(-near[np.arange(len(own)), own])], ["vec_id", "v", "cell", "away"])

        shards = max(-(-n * width * 4 // shard_bytes), spark.sparkContext.defaultParallelism)
        order = ["cell", "away", "vec_id"]
        ranges = rows.mapInArrow(placed, "vec_id long, v array<double>, cell int, away double").repartitionByRange(shards, *order).sortWithinPartitions(*order)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, cell = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
                v, out = _matrix(batch.column("v"), width), []
                for at in range(0, len(ids), block_rows):
                    m = _narrow(v[at : at + block_rows])
                    out.append((batch.column("shard")[0].as_py(), block, int(cell[at]), len(m), ids[at : at + block_rows].astype("<i8").tobytes(), m.tobytes(), m.max(0).tobytes(), m.min(0).tobytes()))
                    block += 1
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] * 4 + [pa.binary()] * 4, strict=True)], ["shard", "block", "cell", "n", "ids", "matrix", "high", "low"])

        blocks = store.written(ranges.withColumn("shard", F.spark_partition_id()).mapInArrow(cut, _BLOCK), "topk-blocks")
        # at most one row a cell
        begins = {r.cell: r.shard for r in blocks.groupBy("cell").agg(F.min("shard").alias("shard")).collect()}
        first = [begins[max((b for b in begins if b <= c), default=min(begins))] for c in range(len(centre))]
        return BlockIndex(blocks, centre, width, first)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best rows of each of queries(query_id, v), ties to the smaller vec_id."""
        spark = queries.sparkSession
        width, sent, first = self.width, spark.sparkContext.broadcast(self.centre), self.first

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = (_matrix(batch.column("v"), max(width, 1 if not batch.num_rows else max(batch.column("v").value_lengths().to_pylist())))[:, :width] @ sent.value.T).argmax(1) if batch.num_rows else []
                yield pa.record_batch([*batch.columns, pa.array([first[c] for c in cell], pa.int32())], [*batch.schema.names, "home"])

        rows = queries.where("query_id is not null and v is not null").select(F.monotonically_increasing_id().alias("ask"), F.col("query_id").cast("long").alias("query_id"), "v")
        asks = store.written(rows.mapInArrow(homes, "ask long, query_id long, v array<double>, home int"), "topk-asks")
        n, shards = asks.count(), self.blocks.agg(F.max("shard") + 1).first()[0]
        parts = max(1, -(-n // PART))
        none = asks.withColumns({"least": F.lit(None).cast("long"), "least_id": F.lit(None).cast("long")})
        near = store.written(self._meet(none.withColumn("shard", F.col("home")), k, shards, parts), "topk-near")
        # the k-th best of the first shard: at most k rows a query
        kth = near.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best")).where(F.size("best") >= k).select("ask", (-F.col("best")[k - 1].s).alias("least"), F.col("best")[k - 1].vec_id.alias("least_id"))
        others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
        far = self._meet(asks.join(kth, "ask", "left").withColumn("shard", F.explode(others)), k, shards, parts)
        place = F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
        out = store.written(near.unionByName(far).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk")
        store.drop(asks)
        store.drop(near)
        return out

    def _meet(self, asks: DataFrame, k: int, shards: int, parts: int) -> DataFrame:
        """(ask, query_id, vec_id, score): what asks(ask, query_id, v, least, least_id, shard) find in their shards."""
        none = lambda kind: F.lit(None).cast(kind)
        part = F.pmod(F.xxhash64("ask"), F.lit(parts)).cast("int")
        held = self.blocks.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.col("block").cast("long").alias("at"), none("long").alias("query_id"), none("array<double>").alias("v"), none("long").alias("least"), none("long").alias("least_id"), "n", "ids", "matrix", "high", "low")
        come = asks.select("shard", part.alias("part"), F.lit(1).alias("kind"), F.col("ask").alias("at"), "query_id", "v", "least", "least_id", none("int").alias("n"), *[none("binary").alias(c) for c in ("ids", "matrix", "high", "low")])
        order = ["shard", "part", "kind", "at"]
        stream = held.unionByName(come).repartition(shards * parts, "shard", "part").sortWithinPartitions(*order)
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, shard = None, None
            for batch in batches:
                group = np.stack([batch.column(c).to_numpy() for c in ("shard", "part", "kind")], 1)
                cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1), len(group)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if at != tuple(group[a, :2]):
                        at, shard = tuple(group[a, :2]), Shard(width)
                    some = batch.slice(a, b - a)
                    if group[a, 2] == 0:
                        shard.add(some)
                        continue
                    for c in range(0, some.num_rows, BATCH):
                        yield shard.answers(some.slice(c, BATCH), k)

        return stream.mapInArrow(run, "ask long, query_id long, vec_id long, score long")


class Shard:
    """The blocks of one shard, and the search in them."""

    def __init__(self, width: int):
        self.width, self.rows = width, []
        self.ids: list[np.ndarray] = []
        self.matrix: list[np.ndarray] = []
        self.high = self.low = self.least_ids = None
        self.scored = 0

    def add(self, batch: pa.RecordBatch) -> None:
        for n, ids, m, high, low in zip(*[batch.column(c).to_pylist() for c in ("n", "ids", "matrix", "high", "low")], strict=True):
            self.ids.append(np.frombuffer(ids, "<i8"))
            self.matrix.append(_read(m, self.width, n))
            self.rows.append((_read(high, self.width, 1)[0], _read(low, self.width, 1)[0]))

    def answers(self, batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
        asks, keys = batch.column("at").to_numpy(), batch.column("query_id").to_numpy()
        sizes = batch.column("v").value_lengths().to_pylist()
        q = _matrix(batch.column("v"), max([self.width, *sizes]))[:, : self.width]
        least = [c.fill_null(fill).to_numpy(zero_copy_only=False) for c, fill in ((batch.column("least"), _LEAST), (batch.column("least_id"), _MOST))]
        row, score, ids = self.best(q, keys, *least, k)
        return pa.record_batch([pa.array(asks[row]), pa.array(keys[row]), pa.array(ids), pa.array(score)], ["ask", "query_id", "vec_id", "score"])

    def best(self, q: np.ndarray, keys: np.ndarray, least: np.ndarray, least_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, id) of at most k rows a query that come before its (least, least_id), best first."""
        none = np.zeros(0, np.int64)
        row, score, ids = none, none, none
        if not self.rows or not len(q):
            return row, score, ids
        if self.high is None:
            self.high, self.low = (np.stack([np.asarray(r[i], np.float64) for r in self.rows]) for i in (0, 1))
            self.least_ids = np.array([i.min() for i in self.ids])
        # sums of term maxima; doubles round sums of 2**53 and more, so those get room
        size = np.maximum(np.abs(self.high), np.abs(self.low))
        bound = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        slack = np.abs(q) @ size.T
        bound = np.where(slack < 2.0**52, bound, bound + slack * 1e-9)
        by_bound = np.argsort(-bound, axis=1, kind="stable")
        kth, kth_id = least.astype(np.int64).copy(), least_ids.astype(np.int64).copy()
        begin, step, n_blocks = 0, 4, len(self.rows)
        while begin < n_blocks:
            turn = by_bound[:, begin : begin + step]
            top = np.take_along_axis(bound, turn, 1)
            floor = kth.astype(np.float64)[:, None]
            level = top >= floor * (1 - np.sign(floor) * 1e-12)
            if not level.any():
                break
            begin, step = begin + step, step * 2
            # at the bound of the k-th best only a smaller id can come before it
            asked, place = np.nonzero((top > floor) | (level & (self.least_ids[turn] < kth_id[:, None])))
            if not len(asked):
                continue
            block = turn[asked, place]
            order = np.argsort(block, kind="stable")
            asked, block = asked[order], block[order]
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            rows, scores, found = [row], [score], [ids]
            for a, b in zip(cuts, cuts[1:], strict=False):
                who, which = asked[a:b], block[a]
                s = products(q[who], self.matrix[which])
                self.scored += s.size
                there = self.ids[which][None, :]
                better = (s > kth[who][:, None]) | ((s == kth[who][:, None]) & (there < kth_id[who][:, None]))
                x, y = np.nonzero(better & (there != keys[who][:, None]))
                rows.append(who[x])
                scores.append(s[x, y])
                found.append(self.ids[which][y])
            row, score, ids = np.concatenate(rows), np.concatenate(scores), np.concatenate(found)
            # a bitwise complement turns the order of longs around without overflow
            order = np.lexsort((ids, ~score, row))
            row, score, ids = row[order], score[order], ids[order]
            start = np.searchsorted(row, np.arange(len(q)))
            keep = np.arange(len(row)) - start[row] < k
            row, score, ids = row[keep], score[keep], ids[keep]
            full = np.bincount(row, minlength=len(q)) >= k
            end = np.searchsorted(row, np.arange(len(q)), "right") - 1
            kth[full], kth_id[full] = score[end[full]], ids[end[full]]
        return row, score, ids


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries(query_id, v) among vectors(vec_id, v), the query's own id left out."""
    index = BlockIndex.built(vectors)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = index.search(queries, k)
    store.drop(index.blocks)
    return out
