from pathlib import Path

import duckdb
from lodestone.operators.lexical_blocks import BlockIndex
from lodestone.plans.catalog import ORACLES, QUERIES


def same_as_sql(spark, path, name):
    con = duckdb.connect()
    for p in Path(path).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, cursor = QUERIES[name](spark, str(path)), con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    plain = lambda r: tuple(round(float(x), 5) if isinstance(x, (int, float)) else str(x) for x in r)
    assert sorted(plain(r) for r in df.select(*names).collect()) == sorted(map(plain, cursor.fetchall()))


def test_quality_metrics_rank_matches_of_common_terms_too(spark, small, monkeypatch):
    # small tables have no term in 10 000 documents
    monkeypatch.setattr(BlockIndex.search_documents, "__defaults__", (100, 3))
    same_as_sql(spark, small, "quality_metrics")


def test_graph_neighbours_are_exact_when_the_beam_misses_rows(spark, tmp_path):
    import numpy as np
    from pyspark.sql import functions as F

    from lodestone.operators.neighbours import nearest
    from lodestone.operators.vector_graph import GraphIndex

    v = np.random.default_rng(5).normal(size=(900, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").cache()
    asked = rows.where("id % 45 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    listed = lambda df: sorted((r.query_id, r.place, r.id, round(r.distance, 6)) for r in df.collect())
    old, newer = rows.where("id < 800"), rows.where("id >= 780")
    index, want = GraphIndex.built(old, most=300), listed(nearest(asked, rows, 5))
    assert listed(index.search(asked, 5, newer, beam=5, width=1)) != want
    assert listed(index.search(asked, 5, newer, beam=5, width=1, exact=True)) == want


def test_cells_of_several_parts_and_blocks_of_any_shape_give_the_exact_rows(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from lodestone.operators import neighbours

    v = np.random.default_rng(6).integers(-2, 3, size=(400, 3)) + 0.25
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").cache()
    asked = rows.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    d = np.round(np.clip(1 - v[::7] @ v.T, 0, 2), 9)
    want = sorted((7 * q, place, int(i)) for q, row in enumerate(d) for place, i in enumerate(np.lexsort((np.arange(400), row))[:6], 1))
    listed = lambda df: sorted((r.query_id, r.place, r.id) for r in df.collect())
    assert listed(neighbours.nearest(asked, rows, 6)) == want
    monkeypatch.setattr(neighbours, "PART", 16)
    found = neighbours.CellIndex.built(rows, 4).search(asked, 6, 4)
    assert listed(found) == want
    assert "applyInArrow" in str(found._jdf.queryExecution().optimizedPlan()) or "FlatMapGroupsInArrow" in str(found._jdf.queryExecution().optimizedPlan())
    # a task's distances are held for a part of the queries and rows only
    best = neighbours.Best(58, 6)
    monkeypatch.setattr(neighbours, "QUERIES_AT_ONCE", 5)
    monkeypatch.setattr(neighbours, "ROWS_AT_ONCE", 9)
    best.add(np.arange(58), v[::7], np.arange(400), v)
    assert sorted((7 * q, place, int(i)) for q, row in enumerate(best.i) for place, i in enumerate(row, 1)) == want


def test_documents_with_terms_in_more_than_ten_thousand_are_ranked(spark, tmp_path):
    words = lambda i: f"alpha{' beta' * (i % 5)}{' gamma' * (i % 41 == 0)}\n{'alpha ' * (i % 7)}{'delta ' * (i % 3)}"
    docs = spark.createDataFrame([(i, words(i), "notes") for i in range(10_300)], "doc_id long, text string, source string")
    docs.coalesce(1).write.parquet(str(tmp_path / "made"))
    spark.createDataFrame([(1, "alpha beta"), (2, "alpha gamma delta"), (3, "alpha"), (4, "beta gamma")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "asked"))
    for folder, name in (("made", "documents"), ("asked", "benchmark")):
        next((tmp_path / folder).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    same_as_sql(spark, tmp_path, "bm25_documents")
    found = QUERIES["bm25_documents"](spark, str(tmp_path)).collect()
    assert len(found) == 400 and not any(r.limited for r in found)
    # the query of two terms, one of them in all documents, is ranked by both
    best = sorted((r for r in found if r.query_id == 2), key=lambda r: r.place)
    assert all(r.rank < 0 for r in best) and best != sorted(best, key=lambda r: -r.id)


def test_more_documents_than_a_hundred_are_given_if_asked_for(spark, tmp_path):
    from lodestone.operators import lexical, lexical_blocks

    docs = spark.createDataFrame([(i, "", "word " * (i % 9 + 1)) for i in range(130)], "id long, title string, body string")
    asked = spark.createDataFrame([(1, "word")], "query_id long, text string")
    blocks = lexical_blocks.build(docs, "id", lexical.DOCUMENT_WEIGHTS, str(tmp_path / "index"))
    plain = lexical.word_index(docs, "id", lexical.DOCUMENT_WEIGHTS)
    listed = lambda df: sorted((r.place, r.id, r.limited) for r in df.collect())
    assert len(listed(blocks.search_documents(asked, 130))) == 130
    assert listed(blocks.search_documents(asked, 130)) == listed(lexical.search_documents(plain, asked, 130))
