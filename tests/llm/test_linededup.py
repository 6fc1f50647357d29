import random

from lodestone.llm.linededup import drop_recurring_lines

PASSAGE = " ".join(f"word{chr(97 + i % 26)}" for i in range(60))


def run(spark, docs, schema="doc_id long, text string", **settings):
    df = spark.createDataFrame(docs, schema)
    return {r.doc_id: r.text for r in drop_recurring_lines(df, bloom_log2=10, **settings).collect()}


def test_repeated_passages_stay_in_the_first_document_only(spark):
    docs = [(1, f"own line one\n{PASSAGE}\nend"), (2, f"{PASSAGE}\nanother"), (3, f"x\n{PASSAGE}\n{PASSAGE}"), (4, "clean text\nwith lines")]
    assert run(spark, docs) == {1: docs[0][1], 2: "another", 3: "x", 4: docs[3][1]}


def test_variable_fields_generalise(spark):
    line = "User {} opened the file called {} at the main office in {} today again"
    docs = [(1, line.format("alpha", "report", "Rome")), (2, line.format("alpha", "letter", "Rome")), (3, line.format("alpha", "budget", "Rome")), (4, "User alpha opened a very different thing and then went straight back home soon")]
    out = run(spark, docs)
    assert out[1] == docs[0][1] and out[2] == "" and out[3] == "" and out[4] == docs[3][1]


def word(i):
    return "".join(chr(97 + i // 26**p % 26) for p in range(3))


def test_two_fields_generalise_whatever_the_number_of_lines(spark):
    rng = random.Random(4)
    line = "Dear reader this {} was sent to the town of {} by our main office"
    for n in (30, 3000):
        # values dealt evenly, and half of all lines with the same one
        for pick in (lambda: rng.randrange(200), lambda: rng.randrange(200) * rng.randrange(2)):
            docs = [(i, line.format("f" + word(pick()), "t" + word(pick()))) for i in range(n)]
            assert {k for k, text in run(spark, docs).items() if text} == {0}


def test_a_small_template_beside_a_large_one_with_the_same_values(spark):
    large = "We wish you all a pleasant stay in the town of {} this year"
    small = "We wish you good luck with every new house very near {} its hills"
    docs = [(i, large.format(word(i % 20)) + f" {word(i)}") for i in range(1000)] + [(1000 + i, small.format(word(i)) + " now") for i in range(20)]
    # same number of words, same head, and the field at one place
    assert len({len(text.split()) for _, text in docs}) == 1
    assert {k for k, text in run(spark, docs).items() if text} == {0, 1000}


def test_digits_are_variable(spark):
    docs = [(i, f"request {i} took {i * 7} ms on host h{i}") for i in range(1, 4)]
    assert run(spark, docs) == {1: docs[0][1], 2: "", 3: ""}


def test_rows_of_numbers_stay_unless_they_are_equal(spark):
    rows = ["12 7 2019 3.5 44 81", "9 1 1987 0.2 6 5", "12 7 2019 3.5 44 82", "sum 7 2019 3.5 of 82 3 4", "sum 8 2018 3.6 of 81 3 4", "12 7 2019 3.5 44 81"]
    assert run(spark, list(enumerate(rows))) == dict(enumerate([*rows[:-1], ""]))


def test_digits_do_not_count_as_constant_words(spark):
    line = "the total of {} is 7 in {} and {} to 9"
    few = [(i, line.format(word(i), word(30 + i), word(60 + i))) for i in range(4)]
    assert run(spark, few) == dict(few)
    # one field that holds now a word, now a number
    mixed = [(i, f"the parcel for room {x} was left with the guard at the gate") for i, x in enumerate(["blue", "12", "green", "7", "red"])]
    assert {k for k, text in run(spark, mixed).items() if text} == {0}


def test_short_lines_stay(spark):
    docs = [(1, "Of."), (2, "Of."), (3, "a b c d e"), (4, "a b c d e")]
    assert run(spark, docs) == dict(docs)


def test_lines_of_one_document_alone_stay(spark):
    assert run(spark, [(1, f"{PASSAGE}\n{PASSAGE}")]) == {1: f"{PASSAGE}\n{PASSAGE}"}


def test_threshold_of_documents(spark):
    docs = [(i, PASSAGE) for i in range(1, 4)]
    assert run(spark, docs, min_docs=4) == dict(docs)
    assert run(spark, docs, min_docs=3) == {1: PASSAGE, 2: "", 3: ""}


def test_nulls_empty_and_clashing_columns(spark):
    assert run(spark, []) == {}
    rows = [(1, None, 1, "a"), (2, "", 2, "b"), (None, PASSAGE, 3, "c"), (4, PASSAGE, 4, "d"), (5, PASSAGE, 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line long, drop string")
    out = drop_recurring_lines(df, counts=True, bloom_log2=10)
    assert out.columns == ["doc_id", "text", "line", "drop", "n_lines", "n_dropped"]
    got = {r.doc_id: (r.text, r.line, r["drop"], r.n_lines, r.n_dropped) for r in out.collect()}
    assert got == {1: (None, 1, "a", 0, 0), 2: ("", 2, "b", 1, 0), None: (PASSAGE, 3, "c", 1, 0), 4: (PASSAGE, 4, "d", 1, 0), 5: ("", 5, None, 1, 1)}


def test_structured_words_are_told_apart(spark):
    """Words that a polynomial hash modulo a power of two takes for one."""
    for n in (1024, 4096):
        a = "".join("ab"[i.bit_count() & 1] for i in range(n))
        b = a.translate(str.maketrans("ab", "ba"))
        docs = [(i, " ".join([w] * 6)) for i, w in enumerate((a, b, a))]
        assert run(spark, docs) == {0: docs[0][1], 1: docs[1][1], 2: ""}


def test_very_long_texts(spark):
    own = lambda p: "\n".join(f"{p}{word(i)} goes its own way alone number {p}{word(i * 7)}" for i in range(40))
    wide = " ".join(f"w{word(i)}" for i in range(9000))
    docs = [(1, f"{wide}\n{PASSAGE}"), (2, f"{PASSAGE}\n{wide}"), (3, "x" * 400_000)]
    assert run(spark, docs) == {1: docs[0][1], 2: "", 3: docs[2][1]}
    assert run(spark, [(1, own("a")), (2, own("a"))])[2] == ""


def brute_templates(rows, depth=3, share=0.7):
    """Texts after the operator, by its definition over plain lists: families of a leaf, constant words, folds to the end."""
    field = "\0"
    lines = {}
    for key, text in rows:
        for n, line in enumerate(text.split("\n")):
            w = line.split()
            if len(w) < 6:
                continue
            plain = [x for x in w if not any(c.isdigit() for c in x)]
            masked = tuple(field if any(c.isdigit() for c in x) else x for x in w) if 2 * len(plain) >= len(w) else tuple(w)
            lines.setdefault((len(w), masked[:depth]), []).append((key, n, masked))
    drop = {}
    for leaf in lines.values():
        nodes = {m: frozenset((i, x) for i, x in enumerate(m) if x != field and not (any(c.isdigit() for c in x))) for _, _, m in leaf}
        size = len(leaf[0][2])
        name = {m: ("line", m) for m in nodes}
        live = {m: spots for m, spots in nodes.items() if len(spots) >= share * size - 1e-9} if len(nodes) > 1 else {}

        def fold(sets):
            counts = {}
            for s in sets:
                for x in s:
                    counts[x] = counts.get(x, 0) + 1
            out = {}
            for s in sets:
                seen = sorted((counts[x] for x in s if counts[x] > 1), reverse=True)
                need = -int(-(share * size - 1e-9) // 1)
                if len(seen) >= need:
                    out[s] = frozenset(x for x in s if counts[x] > 1 and 2 * counts[x] > seen[need - 1])
            return out

        # the first fold is of lines, so equal constant parts of different lines count apart
        counts = {}
        for s in live.values():
            for x in s:
                counts[x] = counts.get(x, 0) + 1
        now = {}
        need = -int(-(share * size - 1e-9) // 1)
        for m, s in live.items():
            seen = sorted((counts[x] for x in s if counts[x] > 1), reverse=True)
            if len(seen) >= need:
                now[m] = frozenset(x for x in s if counts[x] > 1 and 2 * counts[x] > seen[need - 1])
        while True:
            step = fold(set(now.values()))
            moved = {m: step.get(s, s) for m, s in now.items()}
            if moved == now:
                break
            now = moved
        for m, s in now.items():
            name[m] = ("template", s)
        groups = {}
        for key, n, m in leaf:
            groups.setdefault(name[m], []).append((key, n))
        for places in groups.values():
            owner = min(k for k, _ in places)
            if len({k for k, _ in places}) > 1:
                for k, n in places:
                    if k != owner:
                        drop.setdefault(k, set()).add(n)
    return {key: "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop.get(key, ())) for key, text in rows}


def test_equals_brute_force(spark):
    """Both ways: what recurs by a template goes, and nothing else."""
    rng = random.Random(11)
    frames = ["we met {} near the old town of {} on a very cold day", "we met {} at the new house by {} on one warm day", "order {} of {} pieces left the north store with {} today", "{} {} {} {} {} {} {}", "a plain line that many of them have in common with others"]
    value = lambda: rng.choice([word(rng.randrange(40)), word(rng.randrange(900)), str(rng.randrange(99)), "x1"])
    docs = []
    for i in range(120):
        lines = [f.format(*(value() for _ in range(f.count("{}")))) for f in rng.choices(frames, k=rng.randrange(5))]
        docs.append((i, "\n".join([*lines, rng.choice(["", "short one", "zz " + " ".join(word(rng.randrange(9999)) for _ in range(9))])])))
    assert run(spark, docs) == brute_templates(docs)


def test_exact_recurrence_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    owner = {}
    for key, text in sorted(docs):
        for line in text.split("\n"):
            owner.setdefault(tuple(line.split()), key)
    out = run(spark, docs)
    for key, text in docs:
        # whatever recurs exactly and is long enough is gone; what is left is in its first document or unique
        for line in out[key].split("\n") if out[key] else []:
            words = tuple(line.split())
            assert len(words) < 6 or owner[words] == key
