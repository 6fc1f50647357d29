import math

import pytest
from lodestone.operators.embedding_pass import EmbeddingPass, embedded
from lodestone.sources.manifest import Conflict, Manifest

ROW = "id long, revision long, text string"


def counting():
    """Counts of two letters; can't read texts with an exclamation mark, and fails with the whole batch they are in."""

    def model(texts):
        if any("!" in t for t in texts):
            raise RuntimeError("unreadable")
        return [[float(t.count("a")), float(t.count("b"))] for t in texts]

    return model


model = counting()


def rows(spark, *texts, revision=1):
    return spark.createDataFrame([(i, revision, t) for i, t in enumerate(texts)], ROW)


def held(p):
    return sorted((r.id, r.revision, r.vector and [round(x, 4) for x in r.vector], r.error) for r in p.vectors().collect())


def plain(texts, revision=1):
    out = []
    for i, t in enumerate(texts):
        a, b = (t or "").count("a"), (t or "").count("b")
        bad = "RuntimeError: unreadable" if "!" in (t or "") else None if a or b else "ValueError: the model gave a vector that is not finite or has no length"
        out.append((i, revision, None if bad else [round(a / math.hypot(a, b), 4), round(b / math.hypot(a, b), 4)], bad))
    return out


TEXTS = ["a", "b", "ab", "a!", "aab", None, "", "bbbba", "b!b", "a" * 50_000, "ba", "aa"]


def test_a_bad_row_costs_no_other_row(spark):
    got = sorted((r.id, r.revision, r.vector and [round(x, 4) for x in r.vector], r.error) for r in embedded(rows(spark, *TEXTS).coalesce(1), model, 2, batch=5).collect())
    assert got == plain(TEXTS)


@pytest.mark.parametrize("stop", [0, 1, 2, 3])
def test_killed_after_any_page_it_goes_on(spark, tmp_path, monkeypatch, stop):
    asked = rows(spark, *TEXTS)
    make = lambda: EmbeddingPass(spark, f"file://{tmp_path}/v", "m", 2, page_rows=4)
    make().run(asked, model, budget=stop)
    if stop < 3:
        # killed between writing a page and committing it
        monkeypatch.setattr(Manifest, "commit", lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            make().step(asked, model)
        monkeypatch.undo()
    assert make().state()["pages"] == stop
    state = make().run(asked, model)
    assert (state["pages"], state["done"], state["embedded"], state["failed"]) == (3, True, 8, 4)
    assert held(make()) == plain(TEXTS)
    assert make().run(asked, model) == state


def test_another_pass_takes_new_revisions_and_marked_rows(spark, tmp_path):
    p = EmbeddingPass(spark, f"file://{tmp_path}/v", "m", 2, page_rows=100)
    p.run(rows(spark, "a", "b!", "b"), model)
    p.again()
    calls = spark.sparkContext.accumulator(0)

    def counted(texts, model=model):
        calls.add(len(texts))
        return model(texts)

    now = rows(spark, "a", "b", "b").where("id < 2").unionByName(spark.createDataFrame([(2, 2, "ab")], ROW))
    state = p.run(now, counted)
    assert calls.value == 2 and state["failed"] == 0
    assert [(i, r) for i, r, _, e in held(p) if e is None] == [(0, 1), (1, 1), (2, 1), (2, 2)]


def test_many_rows_of_one_id_stay_on_one_page(spark, tmp_path):
    twice = spark.createDataFrame([(1, r, "a") for r in range(5)] + [(2, 1, "b")], ROW)
    p = EmbeddingPass(spark, f"file://{tmp_path}/v", "m", 2, page_rows=2)
    assert p.run(twice, model)["pages"] == 2
    assert len(held(p)) == 6


def test_odd_models_and_empty_tables(spark, tmp_path):
    one = rows(spark, "a")
    odd = [lambda t: [[1.0]], lambda t: [[float("nan"), 1.0]], lambda t: [], lambda t: None]
    for f in odd:
        assert embedded(one, f, 2).first().error
    p = EmbeddingPass(spark, f"file://{tmp_path}/v", "m", 2)
    assert p.run(one.where("false"), model)["done"] and held(p) == []
    with pytest.raises(Conflict):
        EmbeddingPass(spark, f"file://{tmp_path}/v", "other", 2).state()
    with pytest.raises(ValueError, match="dimensions"):
        EmbeddingPass(spark, f"file://{tmp_path}/w", "m", 3000)
