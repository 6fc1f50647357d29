from lodestone.operators import catalog_state as state
from lodestone.operators.inventory import same_rows
from lodestone.streaming.state import Catalog, busy_folder_stream, clip_stream, container_events, frecency_stream, needs_full_scan, retry_delay
from pyspark.sql import functions as F

CATALOG = "document_id long, identity string, path string, body string, bytes long, revision long, seen long"
CHANGE = "identity string, path string, body string, bytes long"


def _rows(df):
    return {r.identity: (r.document_id, r.path, r.body, r.revision, r.seen) for r in df.collect()}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "/a", "x", 1, 1, 1), (5, "b", "/b", "y", 1, 3, 1), (6, "c", "/c", "z", 1, 1, 1)], CATALOG)
    new = spark.createDataFrame([("a", "/a", "x", 1), ("b", "/b2", "y", 1), ("d", "/c", "w", 1), ("e", "/e", "v", 1), ("e", "/e0", "v", 1)], CHANGE)
    out = _rows(state.upsert(old, new, 2))
    assert out["a"] == (1, "/a", "x", 1, 2)  # seen, unchanged
    assert out["b"] == (5, "/b2", "y", 4, 2)  # moved
    assert "c" not in out  # its path belongs to another identity now
    assert out["d"][1:] == ("/c", "w", 1, 2) and out["e"][1] == "/e"  # hard links keep the first path
    assert {out["d"][0], out["e"][0]} == {7, 8}


def test_tombstones(spark):
    df = spark.createDataFrame([(1, "a", "/p/a", "", 0, 1, 2), (2, "b", "/p/b", "", 0, 1, 1), (3, "c", "/q/c", "", 0, 1, 1)], CATALOG)
    assert set(_rows(state.finish_scan(df, 2, True))) == {"a"}
    assert set(_rows(state.finish_scan(df, 2, False))) == {"a", "b", "c"}
    assert set(_rows(state.finish_scan(df, 2, True, F.col("path").startswith("/p/")))) == {"a", "c"}


def test_dense_ids(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"))
    got = sorted(r.n for r in state.with_dense_ids(rows, "k", "n").collect())
    assert got == list(range(1, 1001))


def test_fence(spark):
    docs = spark.createDataFrame([(1, 2)], "document_id long, revision long")
    done = spark.createDataFrame([(1, 1), (1, 2)], "document_id long, revision long")
    current, stale = state.fenced(done, docs)
    assert current.count() == 1 and stale.count() == 1


def test_clips(spark):
    rows = [("u", i, "add", f"c{i}", 1) for i in range(5)] + [("u", 5, "add", "c0", 1), ("u", 6, "pin", "c1", 1), ("u", 7, "remove", "c4", 1)]
    out = state.clip_order(state.clip_history(spark.createDataFrame(rows, "user_id string, at long, action string, content string, bytes long"), keep=2)).collect()
    assert [r.content for r in out] == ["c1", "c0", "c3"]
    small = state.clip_history(spark.createDataFrame(rows[:5], "user_id string, at long, action string, content string, bytes long"), most_bytes=3)
    assert sorted(r.content for r in small.collect()) == ["c2", "c3", "c4"]


def test_windows(spark):
    s = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0), (1, 4, 1.0)], "pid long, t long, cpu double")
    assert [r.percent for r in state.cpu_percent(s).orderBy("t").collect()] == [None, 50.0, 0.0]
    left = spark.createDataFrame([("k", 1), ("k", 5)], "k string, t long")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y")], "k string, t long, v string")
    assert [r.v for r in state.as_of(left, right, "k", "t", "v").orderBy("t").collect()] == [None, "y"]
    log = spark.createDataFrame([("c", i, "line") for i in range(5)], "c string, t long, line string")
    assert state.bounded_log(log, "c", "t", 10, 9).count() == 2


def test_bags(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x long")
    assert same_rows(a, a) and not same_rows(a, a.distinct())


def test_streams_equal_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(f"u{i % 3}", i * 1000, f"c{i % 4}") for i in range(30)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "user_id string, at long, clip string").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("user_id string, at long, clip string").option("maxFilesPerTrigger", 1).parquet(source)

    def run(df, name):
        df.writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    scores = {r.id: (r.score, r.updated) for r in sorted(run(frecency_stream(stream().withColumnRenamed("user_id", "id")), "frecency"), key=lambda r: r.updated)}
    for key, (score, updated) in scores.items():
        expected = sum(0.5 ** ((updated - at) / (14 * 86400)) for u, at, _ in rows if u == key)
        assert abs(score - expected) < 1e-9
    clips = {r.user_id: r.clips for r in run(clip_stream(stream(), 2), "clips")}
    for user, got in clips.items():
        newest = {}
        for u, at, c in rows:
            if u == user:
                newest[c] = max(at, newest.get(c, 0))
        assert set(got) <= set(newest) and len(got) == 2


def test_catalog_stream_is_idempotent(spark, tmp_path):
    table = Catalog(spark, f"file://{tmp_path}/catalog")
    one = spark.createDataFrame([("a", "/a", "x", 1)], CHANGE)
    assert table.apply(one, 0) and not table.apply(one, 0)
    assert table.apply(spark.createDataFrame([("a", "/a", "y", 1), ("b", "/b", "z", 1)], CHANGE), 1)
    assert _rows(table.read())["a"][3] == 2 and table.read().count() == 2
    one.write.parquet(str(tmp_path / "changes"))
    again = Catalog(spark, f"file://{tmp_path}/catalog2")
    q = again.stream(spark.readStream.schema(CHANGE).parquet(str(tmp_path / "changes")), str(tmp_path / "ck"))
    q.awaitTermination()
    assert again.read().count() == 1


def test_busy_folders_and_policies(spark, tmp_path):
    spark.range(30).select(F.lit("/a").alias("folder"), F.timestamp_seconds(F.col("id")).alias("ts")).coalesce(1).write.parquet(str(tmp_path / "e"))
    df = busy_folder_stream(spark.readStream.schema("folder string, ts timestamp").parquet(str(tmp_path / "e")))
    df.writeStream.outputMode("update").format("memory").queryName("busy").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("busy").agg(F.max("n")).first()[0] == 30
    assert needs_full_scan(129, False) and needs_full_scan(1, True) and not needs_full_scan(128, False)
    assert [retry_delay(i) for i in (0, 1, 5, 9)] == [30, 60, 900, 900]
    lines = spark.createDataFrame([('{"Action":"start","id":"0123456789ab","time":5}',), ('{"Action":"exec","id":"0123456789ab"}',), ("junk",)], "value string")
    assert [r.action for r in container_events(lines).collect()] == ["start"]


def test_both_sides_of_a_keep_set(spark):
    held, keep = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int"), spark.createDataFrame([(2,), (3,), (None,)], "id int")
    assert sorted(map(tuple, state.keep_differences(held, keep).collect())) == [(1, "prune"), (3, "missing")]
