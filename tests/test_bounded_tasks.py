import pyarrow as pa
import pytest
from lodestone import scratch
from lodestone.functions import chunking
from lodestone.llm import licences
from lodestone.operators import catalog_state, embedding_pass, ranking
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("text", "licence"),
    [
        ("Released under MPL 2.0.", "MPL-2.0"),
        ("Distributed under the\n * BSD 3-Clause.", "BSD-3-Clause"),
        ("This work is covered by Apache 2.0.", "Apache-2.0"),
        ("Available under MIT.", "MIT"),
        ("Published under the WTFPL.", "WTFPL"),
        ("Apache 2.0", "Apache-2.0"),
    ],
)
def test_references_without_the_word_licence_are_found(spark, text, licence):
    out = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert list(out.licences) == [licence]


def test_every_known_sentence_and_name_opens_the_cut(spark):
    texts = [*licences.SENTENCES, *(f"Released under {n}." for n in licences.NAMES), *(n for n in licences.NAMES if " " in n)]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    opened = F.col("text").rlike(f"{licences.TRIGGER}|{licences.WORDS}") | F.lower("text").rlike(licences.NOTICED)
    assert [r.text for r in out.where(~opened).collect()] == []


def test_a_page_of_the_embedding_pass_moves_ids_alone(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(scratch, "saved", lambda df, name: kept.append(name) or df)
    limits, limit = [], type(spark.range(1)).limit
    monkeypatch.setattr(type(spark.range(1)), "limit", lambda self, n: limits.append(self.columns) or limit(self, n))
    rows = spark.createDataFrame([(i, 1, "a" * (i % 3)) for i in range(20)], "id long, revision long, text string")
    p = embedding_pass.EmbeddingPass(spark, f"file://{tmp_path}/v", "m", 1, page_rows=6)
    state = p.run(rows, lambda texts: [[1.0] for _ in texts])
    assert state["embedded"] == 20 and state["pages"] == 4
    assert all("text" not in columns for columns in limits) and "embedding-page" not in kept


def test_passages_and_names_are_held_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ranking, "HELD_CHARS", 10)
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["abcd", "efgh", "x" * 30, ""])], ["id", "name"])
    parts = list(ranking._by_characters([batch]))
    assert [p.num_rows for p in parts] == [2, 1, 1] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    docs = spark.createDataFrame([(i, "prose", f"Line {i}.\n\nMore.") for i in range(7)], "document_id long, kind string, body string")
    want = sorted(map(str, chunking.chunked(docs).collect()))
    assert chunking.HELD_CHARS and len(want) >= 7


def test_fenced_joins_have_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(catalog_state, "JOIN_ROWS", 10)
    results = spark.range(100).select(F.col("id").alias("document_id"), (F.col("id") % 3).cast("int").alias("revision"))
    now = spark.range(90).select(F.col("id").alias("document_id"), F.lit(1).alias("revision"))
    current, stale = catalog_state.fenced(results, now)
    assert current.count() == 30 and stale.count() == 70
    assert "RepartitionByExpression [document_id" in current._jdf.queryExecution().optimizedPlan().toString()
