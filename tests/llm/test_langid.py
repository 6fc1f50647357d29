from collections import Counter

import numpy as np
import random
from lodestone.llm import langid
from lodestone.llm.queries import op6_language_id
from pyspark.sql import functions as F


def slow(text, width):
    plain = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    plain = " ".join(plain.split(" ")).split()
    if not plain:
        return None
    x = f" {' '.join(plain)} "
    total = np.zeros(width)
    for gram, n in Counter(x[i : i + 3] for i in range(len(x) - 2)).items():
        a, b, c = (langid.letter_vector(ord(q), width).astype(int) for q in gram)
        total += n * np.roll(a, 2) * np.roll(b, 1) * c
    return total


def test_profiles_equal_the_definition(monkeypatch):
    rng = random.Random(2)
    for kept in (16384, 4):
        monkeypatch.setattr(langid.Encoder, "KEPT", kept)
        encoder = langid.Encoder(128)
        for _ in range(60):
            texts = [None if rng.random() < 0.1 else "".join(rng.choice("abÉ 1\n.xİß") for _ in range(rng.randrange(12))) for _ in range(5)]
            for text, got in zip(texts, encoder.profiles(texts)):
                expected = slow(text, 128)
                assert (got is None) == (expected is None) and (got is None or np.array_equal(got, expected)), repr(text)


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = op6_language_id(spark, small).join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_ties_and_nothing_learned(spark):
    train = spark.createDataFrame([("hello there friend", "b"), ("hello there friend", "a"), (None, "c"), ("x", None)], "text string, lang string")
    prototypes = langid.train(train, 128)
    assert sorted(prototypes) == ["a", "b"]
    docs = spark.createDataFrame([(1, "hello friend", "q"), (2, None, "q"), (3, "123 !!", None)], "doc_id long, text string, score string")
    out = {r.doc_id: (r.lang_pred, r.score > 0) for r in langid.identify(docs, prototypes, ["doc_id"], 128).collect()}
    assert out == {1: ("a", True), 2: ("und", False), 3: ("und", False)}
    nothing = langid.identify(docs, langid.train(train.where("lang = 'z'"), 128), ["doc_id"], 128).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identify(docs.where(F.lit(False)), prototypes, ["doc_id"], 128).count() == 0
