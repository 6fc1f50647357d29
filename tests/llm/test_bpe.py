import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from lodestone.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = ["'s", "s", "t", "re", "ve", "ll", "d", "m", "'", " ", "  ", "\n", "É", "ß", "µ", "1", "²", "!", "!!", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "中文", "é", "İ", "Σ", "ΑΣ", "\xa0", "\x85", "\x1c", "\0", "😀", "the", "and", "ª", "​", "x" * 40, "ab" * 50, "ﬁ"]
    return [None, "", "Hello there, it's 'tis", *("".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500))]


@pytest.mark.parametrize("words", [[], [b"the", b"and", b"there", b"their", "é".encode(), b"'s", b"!", b"sanding", b"landing", b"1"]])
def test_equals_the_library(tmp_path, library, texts, words):
    tok = bpe.Tokenizer(PATH)
    (tmp_path / "lexicon").write_bytes(bpe.Lexicon.compiled(words, tok))
    ids, first = bpe.encode(texts, tok, bpe.Lexicon(str(tmp_path / "lexicon")))
    back = bpe.decode(ids, first, tok)
    for i, text in enumerate(texts):
        expected = library.encode(text or "", add_special_tokens=False).ids
        assert ids[first[i] : first[i + 1]].tolist() == expected, repr(text)
        assert back[i].decode() == library.decode(expected, skip_special_tokens=False)


def test_automaton_is_minimal_and_numbers_words(tmp_path):
    words = sorted(f"{a}{b}{c}ing".encode() for a in "abc" for b in "de" for c in "fgh")
    keys, _, _, final = bpe.minimal_automaton(words)
    assert len(final) - 1 == 7 and int(final.sum()) == 1  # start, three letters, three of the ending
    (tmp_path / "l").write_bytes(bpe.Lexicon.compiled(words, bpe.Tokenizer(PATH)))
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    lexicon = bpe.Lexicon(str(tmp_path / "l"))
    assert lexicon.numbers(data, ends - [len(w) for w in words], ends).tolist() == list(range(len(words)))
    other = np.frombuffer(b"adfinadfingsx", np.uint8)
    assert lexicon.numbers(other, np.array([0, 5]), np.array([5, 13])).tolist() == [-1, -1]


def test_table(spark, library):
    rows = [(1, "The cat's hat", "x"), (2, None, "y"), (3, "naïve 中文", None), (3, "naïve 中文", None)]
    out = bpe.encoded(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, ["doc_id"], lexicon_words=3).collect()
    got = sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in out)
    assert len(got) == 4 and got[1] == (2, 0, b"", "")
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (key, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)) in got
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string"), PATH, ["doc_id"]).count() == 0


def test_colliding_words_are_told_apart(library, tmp_path):
    """Words that a polynomial hash modulo a power of two takes for one, and hashes that are all the same."""
    tok = bpe.Tokenizer(PATH)
    (tmp_path / "lexicon").write_bytes(bpe.Lexicon.compiled([], tok))
    texts = []
    for n in (1024, 2048, 4096):
        a = "".join("ab"[i.bit_count() & 1] for i in range(n))
        texts += [a, a.translate(str.maketrans("ab", "ba"))]
    ids, first = bpe.encode(texts, tok, bpe.Lexicon(str(tmp_path / "lexicon")))
    for i, text in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    data = np.frombuffer(b"oneonetwoon", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])
    example, which = bpe.distinct_words(data, starts, ends, np.zeros(4, np.uint64))
    assert example.tolist() == [0, 2, 3] and which.tolist() == [0, 0, 1, 2]


def test_very_long_texts(spark, library):
    text = "The cat's naïve hat " * 60_000 + "x" * 300_000
    rows = bpe.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, ["doc_id"]).collect()
    assert np.frombuffer(bytes(rows[0].ids), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
