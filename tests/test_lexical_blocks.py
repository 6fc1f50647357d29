import random

import pytest
from lodestone.operators import lexical
from lodestone.operators.lexical_blocks import build, shared
from pyspark.sql import functions as F

DOC = "id long, title string, body string"


def made(n, seed=1):
    """Texts in which a few words are very common and most are rare; some rows are long, null or without words."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    pick = lambda m: " ".join(r.choice(words[: r.choice([2, 8, 60])]) for _ in range(m))
    rows = [(i * 7 + 3, pick(r.randrange(4)), pick(r.choice([1, 5, 20]))) for i in range(n)]
    return [*rows, (10_000, None, None), (10_001, "", "..."), (10_002, "w0", "w0 w1 " * 4000)]


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


QUERIES = ["w0 w1", "w1", "w40 w7", "w59 w58 w57 w56", "absent w0", "absent", "", "w3 w3 W3", "w50 w2 w51", "w0 w1 w2 w3 w4 w5"]


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    docs = spark.createDataFrame(made(700), DOC).cache()
    at = str(tmp_path_factory.mktemp("words") / "index")
    return lexical.word_index(docs, "id", lexical.DOCUMENT_WEIGHTS), build(docs, "id", lexical.DOCUMENT_WEIGHTS, at, span=20, buckets=4)


def rows(df, *columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("most", [3, 100])
def test_strict_and_relaxed_lanes_are_the_exhaustive_ones(spark, both, most):
    plain, blocks = both
    q = asked(spark, *QUERIES)
    columns = ("query_id", "id", "rank", "relaxed", "place")
    assert rows(blocks.search_passages(q, most=most), *columns) == rows(lexical.search_passages(plain, q, most=most), *columns)
    assert rows(blocks.search_strict(q, most), "query_id", "id", "rank", "place") == rows(lexical.search_strict(plain, q, most), "query_id", "id", "rank", "place")
    assert rows(blocks.search_any(q, most), "query_id", "id", "rank", "place") == rows(lexical.search_any(plain, q, most), "query_id", "id", "rank", "place")


@pytest.mark.parametrize("broad", [100, 10_000])
def test_broad_terms(spark, both, broad):
    plain, blocks = both
    q = asked(spark, *QUERIES)
    columns = ("query_id", "id", "rank", "limited", "place")
    got = rows(blocks.search_documents(q, 20, broad), *columns)
    assert got == rows(lexical.search_documents(plain, q, 20, broad), *columns)
    assert any(r[3] for r in got) == (broad == 100)


def test_scope_restricts_before_the_limit(spark, both):
    plain, blocks = both
    scope = spark.createDataFrame([(i,) for i in range(0, 3000, 2)], "id long")
    q = asked(spark, "w0 w1", "w9 w8 w59")
    columns = ("query_id", "id", "rank", "relaxed", "place")
    assert rows(blocks.search_passages(q, scope, 5), *columns) == rows(lexical.search_passages(plain, q, scope, 5), *columns)


def test_ranges_below_the_bound_are_not_read(spark, tmp_path):
    # one range in which the term is frequent in short rows; its bound beats all others
    text = [(i, "t", "needle " * (9 if i % 50 == 0 else 1) + "hay " * (1 if i % 50 == 0 else 60)) for i in range(2000)]
    text += [(5000 + i, "t", "other") for i in range(2500)]
    docs = spark.createDataFrame(text, DOC)
    index = build(docs, "id", lexical.DOCUMENT_WEIGHTS, str(tmp_path / "index"), span=8)
    terms = spark.createDataFrame([(1, "needle")], "query_id long, term string")
    found = index.ranked(terms, None, 5, work=True)
    w = found.first()
    assert w.postings == 2000 and w.read < 0.5 * w.postings
    exhaustive = lexical.search_strict(lexical.word_index(docs, "id", lexical.DOCUMENT_WEIGHTS), asked(spark, "needle"), 5)
    assert rows(found, "id", "rank", "place") == rows(exhaustive, "id", "rank", "place")


def test_postings_of_a_common_term_lie_in_many_blocks_and_a_query_reads_its_folders(spark, both):
    blocks = both[1]
    common = blocks.blocks().where("term = 'w0'").agg(F.max("n").alias("n"), F.count("*").alias("blocks")).first()
    assert common.blocks > 20 and common.n <= 60
    plan = blocks.blocks(asked(spark, "w0").select(F.col("text").alias("term")))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_the_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(made(100), DOC)
    seen = []
    import pyspark.sql.classic.dataframe as classic

    keep = classic.DataFrame.sortWithinPartitions
    monkeypatch.setattr(classic.DataFrame, "sortWithinPartitions", lambda self, *a, **b: seen.append(self) or keep(self, *a, **b))
    build(docs, "id", lexical.DOCUMENT_WEIGHTS, str(tmp_path / "index"), span=20)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_tables(spark, tmp_path):
    index = build(spark.createDataFrame([], DOC), "id", lexical.DOCUMENT_WEIGHTS, str(tmp_path / "none"))
    assert index.search_passages(asked(spark, "a b")).count() == 0
    assert index.search_documents(asked(spark)).count() == 0


def test_an_index_is_built_once_for_the_same_files(spark, tmp_path):
    spark.createDataFrame(made(5), DOC).write.parquet(str(tmp_path / "d.parquet"))
    made_at = []
    make = lambda path: made_at.append(path) or object()
    first = shared(spark, "t", [str(tmp_path / "d.parquet")], make)
    assert shared(spark, "t", [str(tmp_path / "d.parquet")], make) is first and len(made_at) == 1
    spark.createDataFrame(made(6), DOC).write.mode("overwrite").parquet(str(tmp_path / "d.parquet"))
    assert shared(spark, "t", [str(tmp_path / "d.parquet")], make) is not first
