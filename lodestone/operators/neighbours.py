"""Nearest vectors by cosine: an exact scan in blocks of queries, and an index of cells for approximate search.

Vectors are arrays of doubles of unit length and one size; rows with a null vector are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import scratch

FOUND = "query_id long, id long, distance double"
#: Bytes of queries sent to all tasks at once.
BLOCK_BYTES = 32 << 20
#: Below so many rows in scope the exact scan serves; newer vectors are scanned up to as many.
EXACT_BELOW = 2048
#: Id of a place without a row.
NOBODY = np.iinfo(np.int64).max
#: Queries and rows whose distances a task holds at once.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 512, 2048
#: Rows of a part of a cell that one group of a search holds.
PART = 8192


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of doubles, without Python objects; all lists have one size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _blocks(queries: DataFrame, most_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, vectors, bounds) of the queries, a bounded block at a time; the driver holds one block."""
    keys, held, bounds, used = [], [], [], 0
    bound = F.col("bound") if "bound" in queries.columns else F.lit(None)
    for r in queries.select("query_id", "q", bound.cast("double").alias("bound")).where("q is not null").toLocalIterator():
        keys.append(r.query_id)
        held.append(np.array(r.q, np.float64))
        bounds.append(np.nan if r.bound is None else r.bound)
        used += held[-1].nbytes
        if used >= most_bytes:
            yield np.array(keys, np.int64), np.stack(held), np.array(bounds)
            keys, held, bounds, used = [], [], [], 0
    if keys:
        yield np.array(keys, np.int64), np.stack(held), np.array(bounds)


class Best:
    """The best ``most`` rows (distance, id) of each of a number of queries, a block of distances at a time."""

    def __init__(self, queries: int, most: int, bound: np.ndarray | None = None):
        self.bound = np.full(queries, np.nan) if bound is None else bound
        # a place that no row has yet; distances that are no numbers come last, as in a sort
        self.d, self.i = np.full((queries, most), np.nan), np.full((queries, most), NOBODY)

    def add(self, own: np.ndarray, asked: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Compare the queries numbered ``own``, whose vectors are ``asked``, with rows; a part of both at a time."""
        most = self.d.shape[1]
        for q in range(0, len(own), QUERIES_AT_ONCE):
            part, mine = asked[q : q + QUERIES_AT_ONCE], own[q : q + QUERIES_AT_ONCE]
            for at in range(0, len(ids), ROWS_AT_ONCE):
                d = np.round(np.clip(1.0 - part @ v[at : at + ROWS_AT_ONCE].T, 0.0, 2.0), 9)
                # only rows that reach a query's worst place so far are sorted
                row, column = np.nonzero(~(d > np.fmin(self.d[mine, -1:], self.bound[mine, None])))
                if not len(row):
                    continue
                held, here = np.unique(row), mine[np.unique(row)]
                new = np.concatenate([np.repeat(np.arange(len(held)), most), np.searchsorted(held, row)])
                far = np.concatenate([self.d[here].ravel(), d[row, column]])
                key = np.concatenate([self.i[here].ravel(), ids[at + column]])
                order = np.lexsort((key, far, new))
                first = np.searchsorted(new[order], np.arange(len(held)))
                pick = order[first[:, None] + np.arange(most)]
                self.d[here], self.i[here] = far[pick], key[pick]

    def found(self, keys: np.ndarray) -> pa.RecordBatch:
        row, place = np.nonzero(self.i != NOBODY)
        return pa.record_batch([pa.array(keys[row]), pa.array(self.i[row, place]), pa.array(self.d[row, place])], ["query_id", "id", "distance"])


def _scan(block, most: int):
    """The best ``most`` rows of a task for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, asked, bound = block.value
        best = Best(len(keys), most, bound)
        for batch in batches:
            best.add(np.arange(len(keys)), asked, batch.column("id").to_numpy(), matrix(batch.column("v")))
        yield best.found(keys)

    return run


def _best(found: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= most)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all tasks: small files of vectors are much work."""
    return rows.repartition(2 * max(1, rows.sparkSession.sparkContext.defaultParallelism))


def nearest(queries: DataFrame, rows: DataFrame, most: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, distance, place): the exact best rows(id, v) of each of queries(query_id, q).

    With queries(query_id, q, bound) only rows within a query's bound are looked for, where it is not null.

    Queries go to all tasks in blocks of bounded bytes; each task keeps its best per query, and only those meet.
    Several blocks run in turn: each is written and its broadcast released before the next is read.
    """
    spark = rows.sparkSession
    plain = spread(rows.where("v is not null").select(F.col("id").cast("long").alias("id"), "v"))

    def scanned(block) -> tuple[DataFrame, object]:
        sent = spark.sparkContext.broadcast(block)
        return plain.mapInArrow(_scan(sent, most), FOUND), sent

    blocks = _blocks(queries, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return _best(spark.createDataFrame([], FOUND), most)
    if second is None:
        return _best(scanned(first)[0], most)
    path = scratch.fresh(spark, "nearest")
    for block in itertools.chain([first, second], blocks):
        found, sent = scanned(block)
        _best(found, most).drop("place").write.mode("append").parquet(path)
        sent.destroy()
    return _best(spark.read.schema(FOUND).parquet(path), most)


def centroids(rows: DataFrame, cells: int, sample: int = 32_768, rounds: int = 10) -> np.ndarray:
    """Unit centres of rows(id, v), fitted by spherical k-means on at most ``sample`` rows, chosen by a hash of the id."""
    picked = rows.where("v is not null").select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample)
    v = matrix(picked.select("v").toArrow().column("v")).astype(np.float32)
    if not len(v):
        return np.zeros((0, 0))
    centre = v[:: max(1, len(v) // cells)][:cells].copy()
    for _ in range(rounds):
        own = np.argmax(v @ centre.T, axis=1)
        for c in np.unique(own):
            total = v[own == c].sum(0)
            length = np.linalg.norm(total)
            if length:
                centre[c] = total / length
    return centre


@dataclass
class CellIndex:
    """rows(id, v, cell) by nearest centre; every row is indexed, whatever the sample that fitted the centres."""

    centre: np.ndarray
    rows: DataFrame

    @staticmethod
    def built(rows: DataFrame, cells: int, sample: int = 32_768) -> CellIndex:
        centre = centroids(rows, cells, sample)
        return CellIndex(centre, _celled(rows.where("v is not null").select(F.col("id").cast("long").alias("id"), "v"), "v", centre, 1))

    def written(self, spark: SparkSession, path: str) -> CellIndex:
        """The index on storage, a folder for each cell, so a search reads the cells it probes."""
        self.rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)
        return CellIndex(self.centre, spark.read.schema(self.rows.schema).parquet(path))

    def search(self, queries: DataFrame, most: int, probes: int, newer: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
        """(query_id, id, distance, place): the best rows of the ``probes`` nearest cells of each query.

        ``newer``(id, v) are vectors since the index was built; they are scanned exactly and replace indexed rows
        of their ids. ``scope``(id) restricts rows; a scope of few rows is scanned exactly.
        """
        held = self.rows
        if newer is not None:
            held = held.join(newer.select("id"), "id", "left_anti")
        if scope is not None:
            scope = scope.select("id").distinct()
            if scope.limit(EXACT_BELOW + 1).count() <= EXACT_BELOW:
                every = held.select("id", "v") if newer is None else held.select("id", "v").unionByName(newer.select("id", "v"))
                return nearest(queries, every.join(scope, "id", "left_semi"), most)
            held = held.join(scope, "id", "left_semi")
        asked = _celled(queries.where("q is not null").select("query_id", "q"), "q", self.centre, probes)
        # a cell's rows meet its queries as two matrices, in parts of both of bounded size
        sides = held.select("cell", "id", "v"), asked.select("cell", F.col("query_id").cast("long").alias("id"), F.col("q").alias("v"))
        parts = [side.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias(n)) for side, n in zip(sides, ("of_rows", "of_queries"))]
        sizes = F.broadcast(parts[0].join(parts[1], "cell"))
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = sides[0].join(sizes, "cell").select("cell", own("of_rows").alias("row_part"), all_of("of_queries").alias("query_part"), F.lit(False).alias("asks"), "id", "v")
        asks = sides[1].join(sizes, "cell").select("cell", all_of("of_rows").alias("row_part"), own("of_queries").alias("query_part"), F.lit(True).alias("asks"), "id", "v")
        near = rows.unionByName(asks).groupBy("cell", "row_part", "query_part").applyInArrow(_met(most), FOUND)
        if newer is not None:
            fresh = newer if scope is None else newer.join(scope, "id", "left_semi")
            near = near.unionByName(nearest(queries, fresh, most).drop("place"))
        return _best(near, most)


def _celled(rows: DataFrame, column: str, centre: np.ndarray, probes: int) -> DataFrame:
    """rows with ``cell``, once for each of the ``probes`` nearest centres of a vector column."""
    held = rows.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(held.value):
                continue
            v = matrix(batch.column(column))
            order = np.argsort(-(v @ held.value.T), axis=1, kind="stable")[:, :probes]
            again = batch.take(pa.array(np.repeat(np.arange(len(v)), order.shape[1])))
            yield pa.record_batch([*again.columns, pa.array(order.ravel().astype(np.int32))], [*again.schema.names, "cell"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, cell int")


def _met(most: int):
    def run(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        ids, v = group.column("id").to_numpy(), matrix(group.column("v"))
        best = Best(int(asks.sum()), most)
        if asks.any():
            best.add(np.arange(len(best.d)), v[asks], ids[~asks], v[~asks])
        return pa.Table.from_batches([best.found(ids[asks])])

    return run


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dots = np.einsum("ij,ij->i", matrix(batch.column("q")), matrix(batch.column("v"))) if batch.num_rows else np.zeros(0)
        yield pa.record_batch([batch.column("query_id"), batch.column("id"), pa.array(np.round(np.clip(1.0 - dots, 0.0, 2.0), 9))], ["query_id", "id", "distance"])


def by_document(found: DataFrame, owners: DataFrame, most: int) -> DataFrame:
    """found(query_id, id, distance) as documents of owners(id, document_id): each by its nearest vector."""
    best = found.join(owners.select("id", "document_id"), "id").groupBy("query_id", "document_id").agg(F.min("distance").alias("distance"))
    return _best(best.withColumnRenamed("document_id", "id"), most).withColumnRenamed("id", "document_id")
