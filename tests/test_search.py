from lodestone.functions.text import question_terms
from lodestone.functions import vectors
from lodestone.operators import fusion, inventory, lexical
from lodestone.plans.search import nearest
from pyspark.sql import functions as F

DOCS = [(1, "Invoice", "renewal deadline for the vendor"), (2, "Notes", "deadline of the project"), (3, "Été", "Café RENEWAL déadline"), (4, "Empty", None)]


def _index(spark):
    docs = spark.createDataFrame(DOCS, "id long, title string, body string")
    return lexical.word_index(docs, "id", lexical.DOCUMENT_WEIGHTS)


def _asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_all_terms_accents_folded(spark):
    out = lexical.search_documents(_index(spark), _asked(spark, "renewal deadline", "cafe", "absent", "the")).collect()
    found = {q: {r.id for r in out if r.query_id == q} for q in range(4)}
    assert found == {0: {1, 3}, 1: {3}, 2: set(), 3: {1, 2}} and not any(r.limited for r in out)


def test_titles_weigh_more(spark):
    out = lexical.search_documents(_index(spark), _asked(spark, "notes")).collect()
    assert [r.id for r in out] == [2] and out[0]["rank"] < 0


def test_broad_terms_give_newest_ids(spark):
    out = lexical.search_documents(_index(spark), _asked(spark, "deadline"), broad=2).orderBy("place").collect()
    assert [r.id for r in out] == [3, 2, 1] and all(r.limited and r["rank"] == 0 for r in out)


def test_relaxed_lane_follows_the_strict_one(spark):
    out = lexical.search_passages(_index(spark), _asked(spark, "renewal vendor")).orderBy("place").collect()
    assert out[0].id == 1 and not out[0].relaxed and [r.id for r in out[1:]] == [3] and out[1].relaxed


def test_scope_restricts_before_the_limit(spark):
    scope = spark.createDataFrame([(2,)], "id long")
    out = lexical.search_passages(_index(spark), _asked(spark, "deadline"), scope, most=1).collect()
    assert [r.id for r in out] == [2]


def test_a_stored_index_reads_only_its_terms_buckets(spark, tmp_path):
    index, asked = _index(spark), _asked(spark, "renewal deadline", "notes")
    stored = index.written(str(tmp_path / "index"), buckets=16)
    out = lexical.search_documents(stored, asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line and "bucket" in line]
    assert scans and all("bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, lexical.search_documents(index, asked).collect()))


def test_question_terms(spark):
    row = spark.range(1).select(question_terms(F.lit("Where did the Invoice, invoice and AUDIT go?")).alias("t")).first()
    assert row.t == ["invoice", "audit"]


def test_fusion_example(spark):
    lex = spark.createDataFrame([(0, 8, 0), (0, 2, 1), (0, 2, 2)], "query_id long, id long, position int")
    sem = spark.createDataFrame([(0, 2, 0), (0, 9, 1)], "query_id long, id long, position int")
    out = fusion.fuse_ranks(lex, sem).orderBy("place").collect()
    assert [r.id for r in out] == [2, 8, 9]
    assert out[0].words and out[0].meaning and abs(out[0].score - (2 / 62 + 1 / 61)) < 1e-9


def test_overlap():
    assert fusion._overlap("abcdefghij", "xxabcdefghijyy")
    assert fusion._overlap("0123456789", "23456789zz")
    assert not fusion._overlap("0123456789", "56789abcde")
    assert fusion._overlap("", "") and not fusion._overlap("", "a")


def test_selection_caps_each_document(spark):
    ranked = spark.createDataFrame([(0, i, 1.0 - i / 10, i) for i in range(1, 6)], "query_id long, id long, score double, place int")
    passages = spark.createDataFrame([(1, 7, "alpha beta"), (2, 7, "alpha beta"), (3, 7, "gamma"), (4, 7, "delta"), (5, 8, "alpha beta")], "id long, document_id long, text string")
    out = fusion.select_fused(ranked, passages).orderBy("place").collect()
    assert [r.id for r in out] == [1, 3, 5]


def test_context_budget(spark):
    rows = spark.createDataFrame([(0, i, i, "x" * 1790) for i in range(1, 7)], "query_id long, id long, place int, text string")
    out = fusion.context(rows).orderBy("place").collect()
    assert [len(r.text) for r in out] == [1790, 1790, 1790, 1630]


def test_best_window():
    body = "a " * 100 + "needle and needle " + "b " * 100
    assert "needle" in fusion.best_window(body, ["needle"], 40)
    assert fusion.best_window(body, ["missing"], 10) == "a a a a a "
    assert fusion.best_window("", ["x"], 10) is None


def test_quantisation(spark):
    rows = spark.createDataFrame([(1, [1.0, -0.5, 0.25]), (2, [0.0, 0.0]), (3, [2.5, 127.0])], "id long, v array<double>")
    q = rows.withColumn("s", vectors.scale_of(F.col("v"))).withColumn("q", vectors.quantised(F.col("v"), F.col("s"))).orderBy("id").collect()
    assert q[0].q == [127, -64, 32] and q[1].s is None and q[2].q == [3, 127]


def test_nearest_and_recall(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, v array<double>").select("id", vectors.unit(F.col("v")).alias("v"))
    asked = rows.where("id = 3").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    out = nearest(asked, rows, 3).orderBy("place").select("query_id", "id", F.col("place").alias("position"))
    assert [r.id for r in out.collect()] == [3, 4, 5]
    assert inventory.recall_at(out, out, 3).first().recall == 1.0


def test_cell_index_against_the_exact_scan(spark, tmp_path):
    import random

    from lodestone.operators.neighbours import CellIndex

    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = spark.createDataFrame([(i, [x + rng.gauss(0, 0.4) for x in centres[i % 20]]) for i in range(2000)] + [(5000, None)], "id long, e array<double>")
    rows = rows.select("id", vectors.unit(F.col("e")).alias("v")).cache()
    asked = rows.where("id % 50 = 0 and v is not null").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    exact = nearest(asked, rows, 10, block_bytes=1000)
    as_list = lambda df: df.select("query_id", "id", F.col("place").alias("position"))
    whole = sorted((r.query_id, r.position, r.id) for r in as_list(exact).collect())
    index = CellIndex.built(rows, 20, sample=500).written(spark, str(tmp_path / "cells"))
    assert index.rows.count() == 2000
    assert sorted((r.query_id, r.position, r.id) for r in as_list(index.search(asked, 10, 20)).collect()) == whole
    assert inventory.recall_at(as_list(index.search(asked, 10, 4)), as_list(exact), 10).first().recall >= 0.9
    older = CellIndex.built(rows.where("id < 1500"), 20)
    assert sorted((r.query_id, r.position, r.id) for r in as_list(older.search(asked, 10, 20, newer=rows.where("id >= 1400"))).collect()) == whole
    scope = rows.where("id < 700").select("id")
    scoped = as_list(index.search(asked, 3, 1, scope=scope)).collect()
    assert sorted((r.query_id, r.position, r.id) for r in scoped) == sorted((r.query_id, r.position, r.id) for r in as_list(nearest(asked, rows.where("id < 700"), 3)).collect())
