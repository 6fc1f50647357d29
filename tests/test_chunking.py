from lodestone.functions.chunking import Limits, chunked, chunks, heading_level, kind_of, sentence_passages, split_identifier, symbols
from pyspark.sql import functions as F


def texts(found):
    return [c[4] for c in found[0]]


def test_paragraphs_keep_their_headings_and_lines():
    note = "# Plan\n\nThe fleet leaves at dawn.\n\n## Ships\n\nThree carry grain and one carries salt.\n\nTwo stay behind to guard.\n"
    found, cut = chunks("prose", note, Limits(target=40))
    assert [c[3] for c in found] == ["Plan", "Plan > Ships", "Plan > Ships"]
    assert [c[2] for c in found] == [3, 7, 9]
    assert not cut and all("#" not in t for t in texts((found, cut)))


def test_overlap_starts_at_a_sentence_and_keeps_the_old_heading():
    found = chunks("prose", "One is here. Two is here.\n\n# New\n\nThis paragraph is long enough to break.\n", Limits(target=30, overlap=14))
    assert texts(found)[1].startswith("Two is here.")
    assert found[0][1][3] == "" and found[0][1][2] == 5


def test_a_wall_of_text_is_cut_on_character_boundaries():
    found, _ = chunks("prose", "é" * 500, Limits(target=101))
    assert all(len(t.encode()) <= 202 for t in texts((found, False))) and "".join(texts((found, False))) == "é" * 500


def test_code_breaks_at_declarations():
    source = "import x\n\ndef first_part(a):\n" + "    y = 1\n" * 25 + "\nclass Second:\n" + "    z = 2\n" * 25
    found, _ = chunks("code", source)
    assert [c[3] for c in found] == ["def first_part(a)", "class Second"]
    assert "first part" in found[0][5]


def test_pages_and_sections():
    assert [(c[0], c[1]) for c in chunks("paged", "a\fb\fc")[0]] == [(0, 1), (1, 2), (2, 3)]
    assert [c[3] for c in chunks("sections", "# A\n\nx\f# B\n\ny")[0]] == ["A", "B"]


def test_ceilings_mark_the_cut():
    long = "word " * 5000
    assert chunks("prose", long, Limits(target=100, max_chunks=5))[1]
    found, cut = chunks("prose", long, Limits(max_bytes=500))
    assert cut and sum(len(t) for t in texts((found, cut))) <= 500


def test_identifiers():
    assert split_identifier("searchFiltered") == ["search", "Filtered"]
    assert split_identifier("content_fts") == ["content", "fts"]
    assert split_identifier("HTTPServer") == ["HTTPServer"]
    assert symbols("let vectorShard = rebuild_cache(); plain words") == "vector shard rebuild cache"
    assert heading_level("### x") == 3 and heading_level("####### x") == 0 and heading_level("###") == 0


def test_nothing_from_nothing():
    for kind in ("prose", "code", "paged", "sections"):
        assert chunks(kind, " \n\n\t\n") == ([], False)


def test_sentences():
    assert sentence_passages("One. Two! Three?", 9) == ["One. Two!", "Three?"]


def test_chunked_table(spark):
    rows = spark.createDataFrame([(1, "/a/b.md", "x\n\ny"), (2, "/c.rs", "fn a() {}"), (3, "/d.md", None)], "document_id long, path string, body string")
    out = chunked(rows.withColumn("kind", kind_of(F.col("path"), F.lit(False)))).collect()
    assert sorted((r.document_id, r.ordinal) for r in out) == [(1, 0), (2, 0)]


def test_whole_texts_are_cut_into_passages():
    # more than 400 passages and more than 2 MiB, in paragraphs, in one long line and as code
    many = "".join(f"Paragraph number {n} of a long note.\n\n" for n in range(70_000))
    found, cut = chunks("prose", many)
    assert not cut and len(many) > 2 * 1024 * 1024 and len(found) > 400
    assert "number 69999 of" in found[-1][4] and [c[0] for c in found] == list(range(len(found)))
    wall = "é" * 1_500_000
    found, cut = chunks("prose", wall)
    assert not cut and "".join(c[4] for c in found) == wall
    code = "".join(f"def f{n}():\n    return {n}\n" for n in range(120_000))
    found, cut = chunks("code", code)
    assert not cut and len(code) > 2 * 1024 * 1024 and found[-1][4].endswith("return 119999")


def test_passages_of_one_long_text_are_sent_on_in_parts(spark, monkeypatch):
    from lodestone.functions import chunking

    body = "".join(f"Paragraph number {n} of a long note.\n\n" for n in range(20_000))
    rows = spark.createDataFrame([(1, "prose", body), (2, "prose", "short"), (3, "prose", body)], "document_id long, kind string, body string")
    found = chunked(rows).orderBy("document_id", "ordinal").collect()
    want = [(key, *c) for key in (1, 2, 3) for c in chunks("prose", "short" if key == 2 else body)[0]]
    assert [tuple(r)[:-1] for r in found] == want and not any(r.truncated for r in found) and len(want) > 1400
    # a ceiling that is asked for still holds, and is told
    few = chunked(rows, Limits(max_chunks=3)).groupBy("document_id").agg(F.count("*").alias("n"), F.bool_or("truncated").alias("cut")).collect()
    assert sorted(map(tuple, few)) == [(1, 3, True), (2, 1, False), (3, 3, True)]
