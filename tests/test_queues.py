import random
import time

import pytest
from lodestone.streaming.queues import PATHS, Queue, Union, file_event_flushes, file_event_stream, queue_stream, queues, with_rocksdb

EVENT = "root string, at long, path string, dropped boolean"
ITEM = "key string, at long, size long, item string"


@pytest.fixture(scope="module")
def rocks(spark):
    from lodestone.streaming.queues import STORE

    with_rocksdb(spark)
    yield spark
    for k in STORE:
        spark.conf.unset(k)


def test_when_a_flush_is_due():
    u = Union()
    u.add(1_000, "a", False)
    assert u.due == 3_000
    u.add(2_900, "b", False)
    assert u.flush() == (3_000, False, ["a", "b"])
    u.add(5_000, "c", False)
    assert u.due == 13_000
    assert u.flush() == (13_000, False, ["c"])
    u.add(60_000, None, False)
    assert u.flush() == (62_000, True, [])


def test_too_many_paths_or_a_dropped_event_give_one_full_scan():
    u = Union()
    for i in range(PATHS):
        u.add(0, str(i), False)
    assert not u.full and len(u.paths) == PATHS
    u.add(0, "more", False)
    u.add(1, "later", False)
    assert u.flush() == (2_000, True, [])
    u.add(5_000, "x", True)
    u.add(5_001, "y", False)
    assert u.flush()[1:] == (True, [])


def test_a_queue_keeps_the_longest_end_that_fits():
    r = random.Random(2)
    for _ in range(30):
        sizes = [r.randrange(1, 60) for _ in range(40)]
        q = Queue(7, 150, 50)
        for i, s in enumerate(sizes):
            q.push(i, s, str(i))
        fit = [(i, s, str(i)) for i, s in enumerate(sizes) if s <= 50]
        n = max(n for n in range(8) if sum(s for _, s, _ in fit[len(fit) - n :]) <= 150)
        assert q.items == fit[len(fit) - n :]


def test_batch_forms_replay_the_rules(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.randrange(200_000), r.choice([None, *map(str, range(30))]) if r.random() < 0.1 else str(r.randrange(30)), r.random() < 0.02) for _ in range(600)]
    expected = []
    for root in ("a", "b"):
        u = Union(5)
        for _, at, path, dropped in sorted((x for x in rows if x[0] == root), key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3])):
            if u.due is not None and at >= u.due:
                expected.append((root, *u.flush()))
            u.add(at, path, dropped)
        expected.append((root, *u.flush()))
    got = file_event_flushes(spark.createDataFrame(rows, EVENT), 5).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    items = [(r.choice(["k", "l"]), i, r.randrange(1, 60), f"i{i}") for i in range(100)]
    want = []
    for key in ("k", "l"):
        q = Queue(7, 150, 50)
        for _, *x in (x for x in items if x[0] == key):
            q.push(*x)
        want += [(key, i, *x) for i, x in enumerate(q.items, 1)]
    assert sorted(map(tuple, queues(spark.createDataFrame(items, ITEM), 7, 150, 50).collect())) == sorted(want)


def test_batch_forms_of_empty_tables(spark):
    assert file_event_flushes(spark.createDataFrame([], EVENT)).count() == 0
    assert queues(spark.createDataFrame([], ITEM)).count() == 0


def test_a_queue_survives_restarts(rocks, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    seen = {}

    def keep(df, n):
        for r in df.collect():
            seen.setdefault(n, []).append(tuple(r))

    q = Queue(4, 100, 60)
    for n in range(3):
        batch = [("k", n * 10 + i, 20 + 10 * n, f"{n}-{i}") for i in range(3)]
        rocks.createDataFrame(batch, ITEM).coalesce(1).write.mode("append").parquet(source)
        stream = queue_stream(rocks.readStream.schema(ITEM).parquet(source), 4, 100, 60)
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        for _, *x in batch:
            q.push(*x)
        assert sorted(seen[max(seen)]) == [("k", i, *x) for i, x in enumerate(q.items, 1)]


def test_file_events_are_united_over_micro_batches(rocks, tmp_path):
    source, seen = str(tmp_path / "in"), []
    put = lambda *rows: rocks.createDataFrame(rows, "root string, path string, dropped boolean").coalesce(1).write.mode("append").parquet(source)
    put(("r", "a", False), ("r", "b", False), ("s", "x", True))
    stream = file_event_stream(rocks.readStream.schema("root string, path string, dropped boolean").parquet(source))
    run = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + 90
        while len(seen) < 2 and time.time() < end:
            time.sleep(0.3)
        put(("r", "c", False))
        put(("r", "a", False), ("r", "c", False))
        while len(seen) < 3 and time.time() < end:
            time.sleep(0.3)
    finally:
        run.stop()
    first = {r[0]: r for r in seen[:2]}
    assert first["r"][2:] == (False, ["a", "b"]) and first["s"][2:] == (True, [])
    assert (seen[2][0], *seen[2][2:]) == ("r", False, ["a", "c"])
    assert seen[2][1] - first["r"][1] >= 10_000
