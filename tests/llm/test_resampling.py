import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm.resampling import Features, drawn, resample, weighed, words

ROW = "doc_id long, text string"


def plain_words(text):
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def plain_features(text, most, buckets):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, most=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    count = lambda texts: [sum(f.count(b) for f in map(lambda t: plain_features(t, most, buckets), texts)) for b in range(buckets)]
    s, t = count([x for _, x in docs]), count(target)
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((float(t[b]) + 1) * (big_s + float(buckets)) / ((float(s[b]) + 1) * (big_t + float(buckets))))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        f = plain_features(text, most, buckets)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(text)) >= min_words])
    enough = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    rank = {id(r): i for i, r in enumerate(enough[: percent * len(enough) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=repr)


def texts(n):
    vocabulary = ["Ärger", "data", "Spark", "naïve", "x9", "the", "of", "LEARN", "proof", "日本"]
    return [(i, " ".join(vocabulary[(i * 7 + j * j) % len(vocabulary)] + str((i + j) % 5) for j in range(i % 61))) for i in range(n)]


@pytest.mark.parametrize("most", [1, 2])
def test_same_as_brute_force(spark, most):
    docs = [*texts(150), (900, None), (901, ""), (902, "!!! ..."), (None, "words of nobody " * 9), (7, texts(150)[7][1]), (7, texts(150)[7][1]), (903, "Long " * 20_000)]
    target = ["Spark data data of proof1 x92", None, "日本3, LEARN2!"]
    found = resample(spark.createDataFrame(docs, ROW).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), Features(most, 50), percent=30, min_words=20, seed=3)
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(docs, target, most, 50, 30, 20, 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], ROW)
    some = spark.createDataFrame(texts(40), ROW)
    assert resample(none, some, Features(), 10, 20, 1).count() == 0
    assert sorted(map(tuple, resample(some, none, Features(), 10, 20, 1).collect()), key=repr) == brute(texts(40), [], seed=1)


def test_ties_go_to_the_smaller_id_and_ranks_have_no_gaps(spark):
    rows = spark.createDataFrame([(i, 30, 30, 5 if i % 2 else 5) for i in range(400)], "doc_id long, n_words long, n_features long, weight long")
    got = [r for r in drawn(rows.repartition(7), "doc_id", 50, 20, 1).collect() if r["rank"]]
    assert sorted(r["rank"] for r in got) == list(range(1, 201))
    in_order = sorted(got, key=lambda r: r["rank"])
    assert [(-r.score, r.doc_id) for r in in_order] == sorted((-r.score, r.doc_id) for r in got)


def test_scoring_explodes_nothing_and_folds_its_gains(spark):
    docs = spark.createDataFrame(texts(5), ROW)
    plan = weighed(docs, Features(), list(range(10_000)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "split(" not in plan


def test_other_columns_stay_and_clashing_ones_are_refused(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, `a.b` string, n long")
    assert weighed(docs, Features(), [1] * 10_000).columns == ["doc_id", "text", "a.b", "n", "n_words", "n_features", "weight"]
    with pytest.raises(ValueError, match="weight"):
        weighed(docs.withColumnRenamed("n", "Weight"), Features(), [1] * 10_000)
    out = resample(docs.withColumnRenamed("n", "score").withColumnRenamed("a.b", "rank"), docs, Features(), 10, 1, 1)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_words_fold_only_ascii(spark):
    df = spark.createDataFrame([("ÀB c_D é 9",), (None,)], "text string")
    assert [r[0] for r in df.select(words(df.text)).collect()] == [["Àb", "c", "d é", "9"], []]


def test_the_query_is_the_brute_force(spark, small):
    from lodestone.llm.queries import op13_importance_resampling

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = sorted(map(tuple, op13_importance_resampling(spark, small).collect()), key=repr)
    s, t = (Counter(b for x in lot for b in plain_features(x, 1, 10_000)) for lot in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((float(t[b]) + 1) * (n_s + 1e4) / ((float(s[b]) + 1) * (n_t + 1e4)))) for b in s}
    assert {(r[0], r[2]) for r in got} == {(i, sum(gain[b] for b in plain_features(x, 1, 10_000))) for i, x in docs}
