import re

from lodestone.operators import lexical, lexical_blocks
from test_lexical_blocks import DOC, asked, made, rows


def test_postings_meet_no_queries_in_a_shuffle(spark, tmp_path):
    docs = spark.createDataFrame(made(700), DOC)
    index = lexical_blocks.build(docs, "id", lexical.DOCUMENT_WEIGHTS, str(tmp_path / "index"), span=20)
    queries = asked(spark, *["w0 w1"] * 30, "w59 absent")
    block = [(q, ["w0", "w1"]) for q in range(30)]
    out = index._pass(block, docs.schema["id"].dataType, True, 4, False, None, None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(range") == 1 and "hashpartitioning(query_id" not in plan
    # a task sends four rows a query and one of its work, whatever the postings of the words
    assert out.count() <= out.rdd.getNumPartitions() * 30 * 5
    columns = ("query_id", "id", "rank", "place")
    plain = lexical.word_index(docs, "id", lexical.DOCUMENT_WEIGHTS)
    assert rows(index.search_strict(queries, 4), *columns) == rows(lexical.search_strict(plain, queries, 4), *columns)


def test_queries_in_several_passes(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(made(200), DOC)
    index = lexical_blocks.build(docs, "id", lexical.DOCUMENT_WEIGHTS, str(tmp_path / "index"), span=20)
    queries = asked(spark, "w0 w1", "w3", "w40 w7", "absent", "w2")
    want = rows(index.search_any(queries, 7), "query_id", "id", "rank", "place")
    monkeypatch.setattr(lexical_blocks, "QUERY_BLOCK", 2)
    monkeypatch.setattr(lexical_blocks, "HELD_POSTINGS", 10)
    assert rows(index.search_any(queries, 7), "query_id", "id", "rank", "place") == want


def test_tasks_that_count_words_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    import pyspark.sql.classic.dataframe as classic

    seen, keep = [], classic.DataFrame.sortWithinPartitions
    monkeypatch.setattr(classic.DataFrame, "sortWithinPartitions", lambda self, *a, **b: seen.append(self) or keep(self, *a, **b))
    monkeypatch.setattr(lexical_blocks, "TASK_BYTES", 1000)
    lexical_blocks.build(spark.createDataFrame(made(700), DOC), "id", lexical.DOCUMENT_WEIGHTS, str(tmp_path / "index"), span=10)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"hashpartitioning\(range#\d+, (\d+)\)", plan)[1]) > 40
