import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lodestone.llm import jaccard
from lodestone.llm.graph import components

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, k, num, den):
    sets = {}
    for key, text in docs:
        w = WORDS.findall((text or "").translate(LOWER))
        sets[key] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    owners = defaultdict(list)
    for key, s in sets.items():
        for g in s:
            owners[g].append(key)
    common = Counter((b, a) for v in owners.values() for i, a in enumerate(v) for b in v[:i])
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {key: (len(s), find(key)) for key, s in sets.items()}


def run(spark, docs, **settings):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, sketch_log2=10, bloom_log2=12, **settings).collect()}


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_equals_brute_force(spark, k, num):
    rng = random.Random(k)
    common = [f"c{i}" for i in range(40)]
    docs = [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "ONE"), (105, "one two"), (106, "ÉA"), (107, "éa")]
    key = 0
    for family in range(4):
        base = [rng.choice(common) if rng.random() < 0.3 else f"w{family}_{rng.randrange(500)}" for _ in range(90)]
        for copy in range(12):
            docs.append((key, edited(base, rng, rng.choice([0, 0, 1, 2, 3, 4]))))
            key += 1
    chain = [f"t{i}" for i in range(120)]
    for step in range(8):
        docs.append((200 + step, " ".join(chain)))
        chain[step * 12] = f"u{step}"
    docs += [(300 + i, " ".join(rng.choice(common) for _ in range(60))) for i in range(12)]
    assert run(spark, docs, k=k, num=num) == brute(docs, k, num, 100)


@pytest.mark.parametrize(("k", "num", "n"), [(3, 90, 9), (5, 80, 4)])
def test_small_sets_inside_larger_ones(spark, k, num, n):
    docs = []
    for size in range(1, n + 4):
        # texts of that many shingles, one with a word more at its end, one with a word more at its start, and one with a word changed
        for way in range(3):
            words = [f"s{size}_{way}_{i}" for i in range(size + k - 1)]
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join([words + ["x"], ["x", *words], words[:-1] + ["x"]][way]))]
    out = run(spark, docs, k=k, num=num)
    assert out == brute(docs, k, num, 100)
    joined = {out[a][0] for a, _ in docs[::2] if out[a + 1][1] == a}
    assert min(joined) == n


def test_places_bound_the_partner():
    """A pair whose first common token (in any order) stands too late on either side can't be similar, all others pass."""
    rng = random.Random(3)
    for num, den in ((90, 100), (80, 100), (2, 3)):
        for _ in range(3000):
            x, y = (sorted(rng.sample(range(24), rng.randrange(1, 20))) for _ in "xy")
            both = set(x) & set(y)
            if not both or den * len(both) < num * len({*x, *y}):
                continue
            first = min(both)
            for a, b in ((x, y), (y, x)):
                p, n = a.index(first), len(a)
                assert p < jaccard.prefix_size(n, num, den)
                assert len(b) <= (n - p) * (den + num) // num - n


def test_every_size_up_to_sixty(spark):
    """Sets on the threshold: each text, one with a word more, and one with some words changed."""
    for k, num in ((3, 90), (5, 80)):
        docs = []
        for n in range(1, 61):
            words = [f"z{n}_{i}" for i in range(n)]
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join([*words, "x"])), (len(docs) + 2, " ".join(["y", *words[:-1], "x"]))]
        assert run(spark, docs, k=k, num=num) == brute(docs, k, num, 100)


def test_large_group_without_its_origin(spark):
    """Copies of one text that is not there itself: links of few, near-misses of many; rounds and left pairs both run."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    docs = [(i, edited(base, rng, rng.choice([1, 2, 2, 3, 3, 4]))) for i in range(150)]
    docs += [(500 + i, " ".join(base[: 150 + i])) for i in range(40)]
    assert run(spark, docs, k=3, num=90) == brute(docs, 3, 90, 100)
    assert run(spark, docs, k=5, num=80) == brute(docs, 5, 80, 100)


def test_structured_words_are_told_apart(spark):
    """Words that a polynomial hash modulo a power of two takes for one."""
    docs, want = [], {}
    for i, n in enumerate((1024, 2048, 4096)):
        a = "".join("ab"[j.bit_count() & 1] for j in range(n))
        docs += [(10 * i + 1, a), (10 * i + 2, a.translate(str.maketrans("ab", "ba"))), (10 * i + 3, a.upper())]
        want |= {10 * i + 1: (1, 10 * i + 1), 10 * i + 2: (1, 10 * i + 2), 10 * i + 3: (1, 10 * i + 1)}
    assert run(spark, docs, k=3, num=90) == want


def test_very_long_texts(spark):
    words = [f"l{i % 9973}_{i}" for i in range(120_000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words, "end"])), (3, " ".join(words[:60_000])), (4, "x" * 700_000), (5, "x" * 700_001)]
    assert {k: v[1] for k, v in run(spark, docs, k=3, num=90).items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_repeated_ids_tables_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(50))
    assert run(spark, []) == {}
    rows = spark.createDataFrame([(1, long, 5, "x"), (1, long, 5, "x"), (2, long, 6, None), (None, long, 7, "y")], "doc_id long, text string, n long, sig string")
    out = jaccard.near_duplicates(rows).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (1, 1), (1, 1), (2, 1)]


def test_one_id_with_two_texts_joins_both_groups(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    out = run(spark, [(3, a), (5, a), (2, b), (5, b)])
    assert {k: v[1] for k, v in out.items()} == {2: 2, 3: 2, 5: 2}


def test_bounds_never_fall_below_the_intersection():
    rng = np.random.default_rng(1)
    for n in (5, 300, 3000, 40000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 2**63, n, dtype=np.uint64)]))
        assert jaccard.most_common(jaccard.histogram(x), jaccard.histogram(y)) >= len(np.intersect1d(x, y))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 99), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k <= 60} == {0} and {got[k] for k in (99, 100, 101)} == {99}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
