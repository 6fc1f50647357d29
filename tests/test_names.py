import random

import numpy as np
from lodestone.functions import fuzzy
from lodestone.operators import ranking
from pyspark.sql import functions as F

ALPHABET = "abcABC-_ .12éÉİß"


def _texts(rng, n, longest):
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_alignment_of_batches_is_that_of_single_names():
    rng = random.Random(5)
    names = _texts(rng, 400, 14)
    forms = {f: fuzzy.Names(names, f) for f in (True, False)}
    hits = 0
    for text in [t for t in _texts(rng, 120, 5) if t]:
        fold = fuzzy.folds(text)
        needle = fuzzy.points(text.lower() if fold else text)
        rows = np.arange(len(names))
        scores, bounds = forms[fold].scores(needle, rows), forms[fold].bounds(needle, rows)
        possible = set(forms[fold].candidates(needle))
        for i, name in enumerate(names):
            plain = ranking.fuzzy_match(text, name)
            assert (scores[i] if scores[i] >= 0 else None) == (plain[0] if plain else None), (text, name)
            if plain:
                hits += 1
                assert i in possible and bounds[i] >= plain[0], (text, name)
    assert hits > 1000


def test_search_aligns_few_names_and_keeps_the_best():
    rng = random.Random(6)
    names = ["".join(rng.choice("abcdefgh -") for _ in range(20)) for _ in range(5000)]
    shown, ids, factor = np.array(names, object), np.arange(len(names)), np.ones(len(names))
    form, best, aligned = fuzzy.Names(names, True), fuzzy.Best(10), []
    form.scores = lambda needle, rows: aligned.append(len(rows)) or fuzzy.Names.scores(form, needle, rows)
    fuzzy.search(best, "bead", form, shown, ids, factor)
    want = sorted((-m[0], i) for i, n in enumerate(names) if (m := ranking.fuzzy_match("bead", n)))
    assert list(zip(-best.score, best.id)) == want[:10]
    assert sum(aligned) < len(want) / 3


def _expected(names, asked, most, factors):
    out = []
    for q, text in asked:
        if text is None:
            continue
        found = [(i, n, ranking.fuzzy_match(text, n) if text.strip() else (0, [])) for i, n in names if i is not None and n is not None]
        scored = sorted((-int(m[0] * factors.get(i, 1.0) + 0.5), i, n) for i, n, m in found if m)
        out += [(q, i, n, -s, p + 1) for p, (s, i, n) in enumerate(scored[:most])]
    return sorted(out)


def test_rank_names_against_every_pair(spark):
    rng = random.Random(7)
    names = [(i, t) for i, t in enumerate(_texts(rng, 600, 12))] + [(None, "abc"), (9000, None), (9001, ""), (9002, "a" * 70_000 + "b1")]
    asked = [(i, t) for i, t in enumerate(_texts(rng, 12, 3))] + [(50, " "), (51, None), (52, "a" * 30)]
    used = [(i, float(i % 5), float(i % 3)) for i in range(0, 600, 4)]
    factors = {i: 1 + 0.6 * max(a, b) / (max(a, b) + 3) for i, a, b in used}
    n = spark.createDataFrame(names, "id long, name string").repartition(5).withColumn("place", F.lit(1)).withColumn("score", F.lit("x"))
    q = spark.createDataFrame(asked, "query_id long, text string").withColumn("name", F.lit(0))
    u = spark.createDataFrame(used, "id long, used double, external double")
    want = _expected(names, asked, 20, factors)
    for block in (1024, 4):
        out = ranking.rank_names(n, q, 20, u, block=block)
        assert sorted(tuple(r) for r in out.select("query_id", "id", "name", "score", "place").collect()) == want
    plan = ranking.rank_names(n, q, 20)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rank_names_of_empty_tables_and_text_ids(spark):
    n = spark.createDataFrame([("b", "blue"), ("a", "blue"), ("c", "red")], "id string, name string")
    q = spark.createDataFrame([("x", "bl")], "query_id string, text string")
    assert [(r.query_id, r.id) for r in ranking.rank_names(n, q).orderBy("place").collect()] == [("x", "a"), ("x", "b")]
    assert ranking.rank_names(n.limit(0), q).count() == 0
    assert ranking.rank_names(n, q.limit(0)).count() == 0
    assert ranking.rank_names(n, q, 0).count() == 0


def test_clips(spark):
    rows = [(1, "alpha beta", False, 10), (2, "x" * 499 + "b" + "q", False, 30), (3, "bq", True, 5), (4, None, False, 40)]
    clips = spark.createDataFrame(rows, "clip long, text string, pinned boolean, front long")
    assert [r.clip for r in ranking.search_clips(clips, "  ").orderBy("place").collect()] == [3, 4, 2, 1]
    assert [r.clip for r in ranking.search_clips(clips, "bq").collect()] == [3]
    assert [r.clip for r in ranking.search_clips(clips, "b").orderBy("place").collect()] == [3, 1, 2]  # pins first among equals
    assert ranking.search_clips(clips.limit(0), "b").count() == 0


def test_commands_by_words_and_keywords(spark):
    rows = [("sleep", "Sleep", ["sleep"]), ("displays", "Sleep Displays", None), ("restart", "Restart…", ["reboot", None]), ("none", None, None)]
    commands = spark.createDataFrame(rows, "id string, title string, keywords array<string>")
    ids = lambda text: sorted(r.id for r in ranking.matching_commands(commands, text).collect())
    assert ids("sle") == ["displays", "sleep"] and ids("displ") == ["displays"] and ids(" REBOOT ") == ["restart"]
    assert ids("sl") == [] and ids("restart…") == [] and ids("safari") == []
