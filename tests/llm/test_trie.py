import hashlib
import random
import zlib

import pytest

from lodestone.llm import trie

ROW = "conv_id long, turn long, role string, text string"


@pytest.fixture
def many_tasks(spark):
    """Sorts over more tasks than there are groups, so nodes span boundaries."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def ordered(rows):
    key = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append(((turn is not None, turn or 0, role, key(role, text)), (role, text)))
    return {c: [t for _, t in sorted(v)] for c, v in out.items()}


def brute(paths):
    """Nodes of [(conv_id, [(role, text), ...]), ...] by listing every prefix."""
    held = {}
    for c, path in paths:
        for d in range(len(path) + 1):
            held.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for p in held:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(held, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[b] for b in below) if below else 1
        saved[p] = sum(saved[b] for b in below) + ((len(held[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    ends = lambda p: ",".join(map(str, sorted(c for c, path in paths if tuple(path) == p)))
    return sorted((min(m), len(p), min(held[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in held.items())


def nodes(df):
    return sorted(map(tuple, df.select(trie.NODE).collect()))


def conversations(seed, n=120):
    """Shared beginnings, whole copies, ends inside of others, and one very common conversation."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 3 == 0:
            path = [("user", "common é"), ("assistant", "same"), ("user", "again")]
        else:
            path = [(r.choice(["user", "assistant", None]), r.choice(["a", "b", "ü", None, "", "x" * 50])) for _ in range(r.randrange(5))]
            path = ([("user", "common é")] if c % 2 else []) + path or [("system", "s")]
        rows += [(c, i, *t) for i, t in enumerate(path)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_listing_every_prefix(spark, many_tasks, seed):
    rows = conversations(seed)
    got = trie.prefix_trie(trie.turn_arrays(spark.createDataFrame(rows, ROW)))
    assert nodes(got) == brute(list(ordered(rows).items()))


def test_groups_of_copies_over_many_tasks(spark, many_tasks):
    paths = [(c, [("user", "q"), ("assistant", "w")][: 2 if c % 4 else 1]) for c in range(300)] + [(c, []) for c in range(300, 400)]
    key = lambda role, text: bytes(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest() + len(text).to_bytes(8, "big"))
    df = spark.createDataFrame([(c, [key(*t) for t in p]) for c, p in paths], "conv_id long, turns array<binary>")
    assert nodes(trie.prefix_trie(df)) == brute(paths)


def test_long_lists_of_ends_are_streamed_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    paths = [(c, [("user", "q")]) for c in range(50)]
    df = trie.turn_arrays(spark.createDataFrame([(c, 0, "user", "q") for c, _ in paths], ROW))
    assert nodes(trie.prefix_trie(df)) == brute(paths)


def test_empty_turnless_null_and_repeated(spark):
    empty = spark.createDataFrame([], ROW)
    assert nodes(trie.prefix_trie(trie.turn_arrays(empty))) == []
    assert nodes(trie.prefix_trie(trie.turn_arrays(spark.createDataFrame([(None, 1, "user", "x")], ROW)))) == []
    none = spark.createDataFrame([(4, []), (2, None)], "conv_id long, turns array<binary>")
    assert nodes(trie.prefix_trie(none)) == brute([(4, []), (2, [])])
    twice = spark.createDataFrame([(4, []), (4, [])], "conv_id long, turns array<binary>")
    assert nodes(trie.prefix_trie(twice)) == brute([(4, []), (4, [])])


def test_very_long_texts_and_conversations_ties_and_other_columns(spark):
    rows = [(1, i, "user", "w") for i in range(600)] + [(2, i, "user", "w" if i < 599 else "L" * 2_000_000) for i in range(600)]
    rows += [(3, 0, "b", "x"), (3, 0, "a", "y"), (3, None, "z", "first")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], f"{ROW}, node string, task int")
    assert nodes(trie.prefix_trie(trie.turn_arrays(df))) == brute(list(ordered(rows).items()))


def test_nodes_with_their_turns(spark):
    rows = conversations(5, 40)
    held = spark.createDataFrame(rows, ROW)
    paths = ordered(rows)
    for r in trie.with_turns(trie.prefix_trie(trie.turn_arrays(held)), held).collect():
        assert (r.role, r.text) == (paths[r.conv_id][r.depth - 1] if r.depth else (None, None))


def test_the_query_is_the_brute_force(spark, small, many_tasks):
    from lodestone.llm.queries import op11_prefix_trie

    own = ordered(map(tuple, spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    built = []
    for c, path in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built.append((c, own.get(c - c % 5, [])[:h] + path[h:]))
    assert nodes(op11_prefix_trie(spark, small)) == brute(built)
