import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from lodestone.llm.queries import word_bpe_path
from test_decontaminate import brute as hits
from test_jaccard import brute as groups
from test_linededup import brute_templates
from test_quality import brute as measures


def test_stages_on_a_small_corpus(spark, tmp_path):
    """Each stage's decision on planted cases; the rest comes through whole."""
    passage = " ".join(f"boiler{i}" for i in range(60))
    text = lambda p, n=90: " ".join(f"{p}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    item = " ".join(f"bench{i}" for i in range(14))
    docs = [
        (1, text("alpha"), "en", "s", 0),
        (2, text("alpha").replace("alphaaa", "changed"), "en", "s", 0),
        (3, "too short", "en", "s", 0),
        (4, text("beta") + "\n" + passage, "en", "s", 0),
        (5, text("gamma") + "\n" + passage, "fr", "t", 0),
        (6, text("delta") + "\n" + item + " end", "en", "s", 0),
        (7, text("epsilon"), None, None, 0),
        (8, None, "en", "s", 0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.schema.simpleString() == now.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = now
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in kept.items()}
    assert ids["quality_rules"] == [1, 2, 4, 5, 6, 7] == ids["line_dedup"]
    assert {r.doc_id: passage in r.text for r in kept["line_dedup"].collect() if r.doc_id in (4, 5)} == {4: True, 5: False}
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].collect())
    assert 6 not in ids["benchmark_decontamination"] and ids["bpe_encoding"] == ids["benchmark_decontamination"]
    assert Counter(r.n_tokens > 0 for r in kept["bpe_encoding"].collect()) == {True: len(ids["bpe_encoding"])}


def expected(rows, items):
    """Ids by document as the stages' definitions have them, over plain lists."""
    import tokenizers

    def good(text):
        n, chars, symbols, again, repeated = measures(text)
        lines = sum(1 for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r"))
        return not (n < 50 or 100 * repeated > 50 * n or 10 * symbols > 3 * n or chars < 2 * n or chars > 15 * n or (again > 10 and 10 * again > 3 * lines))

    now = brute_templates([(k, t) for k, t in rows if good(t)])
    now = dict(now)
    now = {k: t for k, t in now.items() if groups(now.items(), 5, 80, 100)[k][1] == k}
    dirty = {k for k, _, n, _ in hits(now.items(), items) if n}
    library = tokenizers.Tokenizer.from_file(word_bpe_path())
    return {k: library.encode(t, add_special_tokens=False).ids for k, t in now.items() if k not in dirty}


def test_run_equals_brute_force(spark, tmp_path):
    pytest.importorskip("tokenizers")
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, notice = text(30), "the office of {} is closed on all days but {} this year"
    items = [(1, text(14)), (2, text(4))]
    rows = []
    for i in range(60):
        body = [text(rng.choice([20, 60, 90]))]
        if i % 5 == 0:
            body.append(line)
        if i % 4 == 0:
            body.append(notice.format(word(), word()))
        if i % 9 == 0:
            body.append(f"now {items[i % 2][1]} then")
        if i % 7 == 0:
            body = body[:1] * 3
        rows.append((i, "\n".join(body)))
    near = [(100 + i, t.replace(" ", f" {word()} ", 1)) for i, t in rows[::6]]
    rows += [*near, (200, ""), (201, None), (202, rows[1][1]), (203, text(70_000))]
    rng.shuffle(rows)
    schema = "doc_id long, text string, lang string, source string, n_chars long, gone string"
    spark.createDataFrame([(*r, "en", "s", 0, "x") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == expected(rows, items)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
