import random
import re
from collections import Counter

from lodestone.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w, lines = WORDS.findall(text), [x for x in text.split("\n") if WORDS.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a a", " lead\x0btail ", "é é é é", "😀 x 😀 x 😀 x", "#|<>\n\n#|<>\n", "x" * 5000, "a b c\n" * 400]
    texts += ["".join(rng.choice("ab #\n\té") for _ in range(rng.randrange(60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measured(rows).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), repr(r.text)


def test_verdicts_and_policies(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(1, clean), (2, "short"), (3, "a b c " * 40), (4, " ".join(f"w{i}##" for i in range(80))), (5, None)]
    out = {r.doc_id: (r.base_failed, r.kept) for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False)}
    kept = quality.keep_good(spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, n_words long, kept string"))
    assert kept.columns == ["doc_id", "text", "n_words", "kept"] and [tuple(r) for r in kept.collect()] == [(1, clean, 9, "z")]


def test_ablations(spark):
    rows = spark.createDataFrame([(1,), (1,), (3,), (4,), (0,)], "fail_bits long")
    got = {(r.policy, r.rule): (r.failed, r.failed_alone, r.rejected) for r in quality.ablations(rows).collect()}
    assert got["base-1", "too_few_words"] == (3, 2, 3)
    assert got["base-1", "repeated_windows"] == (1, 0, 3)
    assert got["web-1", "symbols"] == (1, 1, 4)
    assert len({r.bit for r in quality.RULES}) == len(quality.RULES)


def test_empty_table(spark):
    assert quality.verdicts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_with_one_hash_are_told_apart(spark):
    unlike = " ".join(f"u{i}x{i * i}" for i in range(60))
    text = f"aaaaaaaa bbbbbbbb cccccccc {unlike} aaaaaaaa hhwpspbu dN}}h6#4^"
    rows = spark.createDataFrame([(1, text), (2, f"{text} aaaaaaaa bbbbbbbb cccccccc"), (3, "w " * 60_000), (3, "w " * 60_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_repeat_words) for r in quality.measured(rows).select("doc_id", "n_repeat_words").collect())
    assert got == [(1, 0), (2, 6), (3, 60_000), (3, 60_000)]
