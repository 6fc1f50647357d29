import random

import pytest
from lodestone import scratch
from lodestone.operators.document_store import COLUMNS, DocumentStore
from lodestone.sources.manifest import Conflict, Generations, Manifest

ROW = "identity string, path string, body string, bytes long"


def change(spark, *rows):
    return spark.createDataFrame([(i, p, b, len(b or "")) for i, p, b in rows], ROW)


def table(store, version=None):
    return sorted(map(tuple, store.read(version).select("document_id", "identity", "path", "body", "revision", "seen").collect()))


@pytest.fixture
def store(spark, tmp_path):
    return DocumentStore(spark, f"file://{tmp_path}/store", buckets=4)


def replay(batches):
    """Plain Python version of apply()."""
    rows, top = {}, 0
    for n, batch in enumerate(batches):
        new = {}
        for i, p, b in sorted(batch, key=lambda x: (x[0], x[1])):
            new.setdefault(i, (p, b))
        last = {p: i for i, (p, _) in sorted(new.items())}
        new = {i: x for i, x in new.items() if last[x[0]] == i}
        taken = {p for p, _ in new.values()}
        rows = {i: r for i, r in rows.items() if i in new or r[1] not in taken}
        for i in sorted(new):
            if i not in rows:
                top += 1
            key, path, body, revision, _ = rows.get(i, (top, None, None, 0, 0))
            rows[i] = (key, *new[i], revision + ((path, body) != new[i]), n)
    return sorted((k, i, p, b, r, s) for i, (k, p, b, r, s) in rows.items())


def test_batches_are_the_plain_replay(spark, store):
    r = random.Random(3)
    batches = [[(f"i{r.randrange(12)}", f"/p{r.randrange(12)}", r.choice(["a", "b", None])) for _ in range(6)] for _ in range(4)]
    for n, batch in enumerate(batches):
        assert store.apply(change(spark, *batch), n)
        assert table(store) == replay(batches[: n + 1])
    assert not store.apply(change(spark, ("late", "/late", "x")), 3)
    before = table(store)
    assert store.compact(folders=1)
    assert table(store) == before
    assert table(store, store.state()["version"] - 1) == before
    assert store.vacuum(keep=1)
    assert table(store) == before and store.compact(folders=1) == []


def test_a_batch_writes_its_own_buckets(spark, store):
    store.apply(change(spark, *[(f"i{n}", f"/p{n}", "x") for n in range(40)]), 0)
    before = store.state()
    store.apply(change(spark, ("i7", "/p7", "y")), 1)
    now = store.state()
    touched = [b for b in now["rows"] if now["rows"][b] != before["rows"].get(b)]
    assert len(touched) == 1 and now["owners"] == before["owners"]
    # an unchanged row costs a mark without its body
    store.apply(change(spark, ("i8", "/p8", "x")), 2)
    marks = store._stored(store.state(), "rows").where("mark").collect()
    assert [(m.identity, m.body, m.seen) for m in marks] == [("i8", None, 2)]
    assert [r for r in table(store) if r[1] == "i8"] == [(next(r[0] for r in table(store) if r[1] == "i8"), "i8", "/p8", "x", 1, 2)]


def test_a_batch_that_dies_leaves_the_last_version(spark, store, monkeypatch):
    store.apply(change(spark, ("a", "/a", "1")), 0)
    before = table(store)
    monkeypatch.setattr(Manifest, "commit", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        store.apply(change(spark, ("a", "/a", "2"), ("b", "/b", "3")), 1)
    monkeypatch.undo()
    assert table(store) == before
    assert store.apply(change(spark, ("a", "/a", "2"), ("b", "/b", "3")), 1)
    assert [r[:4] for r in table(store)] == [(1, "a", "/a", "2"), (2, "b", "/b", "3")]


def test_of_two_writers_one_wins(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    base = m.read()
    assert m.commit(base, x=1)["version"] == 1
    with pytest.raises(Conflict):
        m.commit(base, x=2)
    assert m.read() == {"version": 1, "x": 1}
    # a claim that another writer holds refuses the name
    assert scratch.create(spark, f"file://{tmp_path}/m/000000000002.json.claim", "")
    with pytest.raises(Conflict):
        m.commit(m.read(), x=3)
    assert m.read() == {"version": 1, "x": 1}


def test_scans(spark, store):
    store.apply(change(spark, ("a", "/d/a", "1"), ("b", "/d/b", "1"), ("c", "/e/c", "1")), 1)
    store.apply(change(spark, ("a", "/d/a", "1")), 2)
    assert store.finish_scan(2, complete=False) == 0 and len(table(store)) == 3
    assert store.finish_scan(2, complete=True, below="/d") == 1
    assert [r[1] for r in table(store)] == ["a", "c"]
    assert store.finish_scan(2, complete=True) == 1 and store.state()["scans"] == 2
    # a path that was freed can be taken, and its new owner is another row
    store.apply(change(spark, ("z", "/d/b", "9")), 3)
    assert [r[:2] for r in table(store)] == [(1, "a"), (4, "z")]


def test_erase_goes_on_where_it_was_stopped(spark, store):
    store.apply(change(spark, *[(f"i{n}", f"/p{n}", "x") for n in range(20)]), 0)
    store.finish_scan(0, complete=True)
    assert not store.erase(page=1, pages=2)
    with pytest.raises(Conflict):
        store.apply(change(spark, ("n", "/n", "x")), 1)
    assert store.erase(page=1)
    assert table(store) == [] and store.state()["scans"] == 1
    store.apply(change(spark, ("n", "/n", "x")), 1)
    assert [r[:2] for r in table(store)] == [(21, "n")]


def test_empty_batches_and_rows_without_keys(spark, store):
    assert store.apply(change(spark), 0) and table(store) == []
    assert store.apply(change(spark, (None, "/x", "1"), ("y", None, "1")), 1) and table(store) == []
    assert store.read().columns == COLUMNS


def test_a_stream_of_changes(spark, store, tmp_path):
    source = str(tmp_path / "in")
    change(spark, ("a", "/a", "1")).write.parquet(source)
    stream = lambda: spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(source)
    store.stream(stream(), str(tmp_path / "checkpoint")).awaitTermination()
    change(spark, ("a", "/a", "2"), ("b", "/b", "1")).coalesce(1).write.mode("append").parquet(source)
    store.stream(stream(), str(tmp_path / "checkpoint")).awaitTermination()
    assert [r[1:5] for r in table(store)] == [("a", "/a", "2", 2), ("b", "/b", "1", 1)]


def test_generations(spark, tmp_path):
    g = Generations(spark, f"file://{tmp_path}/g")
    vectors = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    for n in range(8):
        g.begin(f"m{n}")
    g.begin("m3")
    with pytest.raises(ValueError, match="8 models"):
        g.begin("m8")
    read = g.currency(vectors)
    assert read == {"count": 5, "last": 5}
    assert not g.activate("m1", stale=1, vectors=5) and not g.activate("m1", stale=0, vectors=0)
    assert g.activate("m1", 0, 5) and g.shards() == {}
    g.publish("m1", "s0", "folder-1", read, vectors)
    assert g.shards() == {"s0": {"count": 5, "last": 5, "folder": "folder-1"}}
    # a builder that read fewer vectors comes too late
    with pytest.raises(Conflict):
        g.publish("m1", "s0", "folder-2", {"count": 4, "last": 4}, vectors)
    assert g.shards()["s0"]["folder"] == "folder-1"
    assert g.activate("m2", 0, 5) and g.shards() == {}
    assert g.retire() == ["m0", "m1", "m3", "m4", "m5", "m6", "m7"]
    with pytest.raises(Conflict):
        g.publish("m1", "s1", "folder-3", read, vectors)


def test_two_builders_race(spark, tmp_path, monkeypatch):
    g, other = (Generations(spark, f"file://{tmp_path}/g") for _ in range(2))
    g.begin("m")
    vectors = spark.createDataFrame([(1,)], "id long")
    read = g.currency(vectors)
    slow = Manifest.commit

    def overtaken(self, base, **changes):
        monkeypatch.setattr(Manifest, "commit", slow)
        other.publish("m", "s", "theirs", read, vectors)
        return slow(self, base, **changes)

    monkeypatch.setattr(Manifest, "commit", overtaken)
    with pytest.raises(Conflict):
        g.publish("m", "s", "mine", read, vectors)
    g.activate("m", 0, 1)
    assert g.shards()["s"]["folder"] == "theirs"
