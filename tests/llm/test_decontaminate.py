import random
import re

from lodestone.llm.decontaminate import clean, contamination

WORDS = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items):
    windows = {}
    for key, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(key))
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w = WORDS.findall((text or "").translate(LOWER))
        hit, who = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    who |= found
        out.append((key, len(w), len(hit), sorted(who)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(9)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(30)), (2, text(10)), (3, text(4)), (4, "solo"), (5, None), (6, ""), (10, text(12)), (10, text(11)), (7, "É É É É É É É É É É É")]
    long = text(40)
    items.append((8, long))
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    docs += [(100, None), (101, "..."), (102, long.upper() + " tail"), (103, f"x {items[1][1]} y"), (104, "a Solo b"), (105, "É " * 30), (106, long), (106, long), (107, "w0 " * 3000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id long, text string, key string, words long")
    got = contamination(rows, bench, bloom_log2=12).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got), key=str) == brute(docs, items)
    dirty = {k for k, _, n, _ in brute(docs, items) if n}
    kept = clean(rows, bench)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in docs if k not in dirty)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in contamination(docs, none, bloom_log2=12).collect()] == [0]
    assert contamination(docs.limit(0), none, bloom_log2=12).count() == 0


def test_null_and_repeated_ids_go_by_their_text(spark):
    item = " ".join(f"b{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "x " + item.upper()), (None, "clean text"), (1, "own words"), (1, item), (2, None), (3, "")]
    df = spark.createDataFrame([(*r, "t", "k") for r in rows], "doc_id long, text string, _text_key string, _dirty_key string")
    kept = clean(df, bench, bloom_log2=12)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "clean text"), (1, "own words"), (2, None), (3, "")], key=str)


def test_structured_words_are_told_apart(spark):
    """Words that a polynomial hash modulo a power of two takes for one."""
    docs, items = [], []
    for n in (1024, 2048, 4096):
        a = "".join("ab"[i.bit_count() & 1] for i in range(n))
        items.append((n, a))
        docs += [(n, f"x {a} y"), (n + 1, f"x {a.translate(str.maketrans('ab', 'ba'))} y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, bloom_log2=12)
    assert {r.doc_id: (r.n_hit, list(r.item_ids)) for r in got.collect()} == {k + d: (1 - d, [str(k)] * (1 - d)) for k in (1024, 2048, 4096) for d in (0, 1)}


def test_very_long_texts(spark):
    item = " ".join(f"b{i}" for i in range(10))
    text = " ".join(f"w{i}" for i in range(150_000))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = contamination(spark.createDataFrame([(1, f"{text} {item} {text}"), (2, text + "z" * 500_000)], "doc_id long, text string"), bench, bloom_log2=12)
    assert {r.doc_id: (r.n_words, r.n_hit) for r in got.collect()} == {1: (300_010, 10), 2: (150_000, 0)}
