import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import topk
from lodestone.llm.topk import BlockIndex, Shard, products, top_k, whole_parts

ROW = "vec_id long, v array<double>"


def whole(v, scale=256):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def brute(rows, asked, k):
    """Sorted (query_id, rank, vec_id, score); rows and asked are (id, whole numbers or None)."""
    out = []
    for q, a in asked:
        if q is None or a is None:
            continue
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(a, b, strict=False)))), i) for i, b in rows if i is not None and b is not None and i != q]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(spark, rows, asked, k, **sizes):
    index = BlockIndex.built(spark.createDataFrame(rows, ROW), **sizes)
    got = index.search(spark.createDataFrame(asked, ROW).withColumnRenamed("vec_id", "query_id"), k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("n", "width", "k", "spread"), [(700, 6, 5, 300), (90, 3, 40, 2), (40, 1, 60, 1)])
def test_same_as_scoring_every_pair(spark, monkeypatch, n, width, k, spread):
    monkeypatch.setattr(topk, "PART", 3)
    r = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in r.integers(-spread, spread + 1, width)]) for i in r.permutation(n) - 20]
    asked = [x for x in rows if x[0] % 50 == 0]
    assert found(spark, rows, asked, k, block_rows=7, shard_bytes=1000, cells=5) == brute(rows, asked, k)


def test_copies_tie_to_the_smaller_id(spark):
    rows = [(i, [3.0, -4.0]) for i in range(400)] + [(i, [1.0, 1.0]) for i in range(400, 420)]
    asked = [rows[0], rows[350], rows[400]]
    assert found(spark, rows, asked, 5, block_rows=4, cells=3) == brute(rows, asked, 5)


def test_nulls_odd_sizes_and_repeated_ids(spark):
    rows = [(1, [1.0, 2.0]), (1, [5.0, 5.0]), (2, None), (None, [9.0, 9.0]), (3, []), (4, [7.0]), (5, [1.0, 1.0, 1.0]), (6, [-1.0, 0.0])]
    asked = [(1, [1.0, 2.0]), (1, [5.0, 5.0]), (2, None), (None, [1.0]), (3, []), (9, [1.0, 0.0, 0.0, 8.0]), (10, [2.0])]
    assert found(spark, rows, asked, 3) == brute(rows, asked, 3)


def test_whole_parts(spark):
    cases = [[0.5, -0.001, 1.0], [], None, [1.0, None], [float("nan")], [float("inf"), 0.0], [1e300, -3.0]]
    got = spark.createDataFrame([(c,) for c in cases], "v array<double>").select(whole_parts(F.col("v"), 256)).collect()
    assert [g[0] for g in got] == [whole(c) for c in cases]


def test_products_are_exact_at_every_size():
    r = np.random.default_rng(1)
    for most in (10, 5_000, 1 << 24, 1 << 30):
        a, b = (r.integers(-most, most, (5, 9)).astype(float) for _ in range(2))
        assert products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert products(np.array([[1e300, 1.0]]), np.array([[1e300, 1.0], [-1e300, 0.0]])).tolist() == [[(1 << 63) - 1, -(1 << 63)]]


def test_large_numbers_through_the_index(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-(1 << 31), 1 << 31, 3)]) for i in range(60)] + [(60, [1e200, 0.0, 0.0])]
    assert found(spark, rows, rows[::10], 4, block_rows=5, cells=4) == brute(rows, rows[::10], 4)


def test_blocks_below_the_kth_best_are_not_scored(spark):
    r = np.random.default_rng(5)
    centre = r.normal(size=(20, 16)) * 100
    rows = [(i, [float(x) for x in np.floor(centre[i % 20] + r.normal(size=16))]) for i in range(4000)]
    index = BlockIndex.built(spark.createDataFrame(rows, ROW), block_rows=16, cells=20)
    shard = Shard(index.width)
    for b in index.blocks.toArrow().to_batches():
        shard.add(b)
    q = np.array([v for _, v in rows[::50]])
    shard.best(q, np.arange(0, 4000, 50), np.full(80, -(1 << 63)), np.full(80, (1 << 63) - 1), 5)
    assert shard.scored < 0.4 * len(q) * len(rows)


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], ROW)
    assert top_k(none, none.withColumnRenamed("vec_id", "query_id"), 5).collect() == []
    rows = spark.createDataFrame([(1, [1.0], "s", 2), (2, [3.0], "t", 3)], f"{ROW}, shard string, score int")
    assert top_k(rows, none.withColumnRenamed("vec_id", "query_id"), 5).collect() == []
    got = top_k(rows, rows.withColumnRenamed("vec_id", "query_id"), 5).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 3), (2, 1, 1, 3)]


def test_the_query_is_the_brute_force(spark, small):
    from lodestone.llm.queries import op12_exact_topk

    rows = [(r.vec_id, whole(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op12_exact_topk(spark, small).collect())) == brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
