import hashlib
import random
from collections import Counter

import pytest
from lodestone.llm import chat, licences, store, tokencounts


def test_chat_round_trip(spark):
    rng = random.Random(5)
    parts = ["<", "|", "\\", "<|turn|>", "<|end|>", "<\\|text|>", "a", "\n", "é", "</s>[INST] ok [/INST]"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|turn|>"]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for c in range(30) for t in range(rng.randrange(1, 6))]
    rows += [(90, 0, "assistant", None), (91, None, None, None), (92, 1, "user", "same"), (92, 1, "user", "same"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int")
    out = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        got = out[c]
        assert (got.n_turns, got.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_every_reply_has_its_own_example(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", "q3")]
    out = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [r.target_turn for r in out] == [1, 3, None]
    assert [r.formatted[r.mask_start : r.mask_end] for r in out[:2]] == ["a1", "a2"]
    assert out[1].formatted.startswith(out[0].formatted) and "q3" not in out[1].formatted and out[2].mask_start is None


def test_licences(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://x'
    rows = [(1, apache), (2, None), (3, ""), (4, "Either version 3 of the License, or (at your option) any later version."), (5, "All rights reserved. Released under the MIT License!"), (6, "text of a license"), (6, "text of a license")]
    out = sorted((r.doc_id, tuple(r.sentence_ids), tuple(r.licences), r.status) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out[0] == (1, ("Apache2Ref", "Apache2Comply", "Apache2Copy"), ("Apache-2.0",), "single")
    assert [x[3] for x in out] == ["single", "none", "none", "unknown", "multiple", "none", "none"]
    assert out[4][2] == ("MIT", "Proprietary")


def test_wrapped_licences(spark):
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
"""
    header = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance
 * with the License. You may obtain a copy
 * of the License at
 *
 *     http://x
 */"""
    lines = "Some title\nReleased under the MIT License\nAll rights reserved\nand more text"
    rows = [(1, bsd), (2, header), (3, header.replace("\n", "\r\n")), (4, lines), (5, "All rights\nreserved."), (6, "All rights\n\nreserved.")]
    out = {r.doc_id: (r.sentence_ids, r.status) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    apache = (["Apache2Ref", "Apache2Comply", "Apache2Copy"], "single")
    assert out == {1: (["BsdGrant", "BsdSource"], "unknown"), 2: apache, 3: apache, 4: (["MitRef", "AllRights"], "multiple"), 5: (["AllRights"], "single"), 6: ([], "none")}


MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
BSD = """Copyright (c) 1998, The Example Foundation. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = (
    BSD
    + """
3. Neither the name of The Example Foundation nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
)
GNU = """# This program is free software{stop} you can redistribute it and/or modify
# it under the terms of the GNU {kind} as published by
# the Free Software Foundation{comma} either version {version} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY.
"""
APACHE = """// Copyright 2020 Some One
//
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
REAL = [
    (MIT, "MIT"),
    (" ".join(MIT.split()), "MIT"),
    (BSD, "BSD-2-Clause"),
    (BSD3, "BSD-3-Clause"),
    (BSD3.replace("\n", "\n * "), "BSD-3-Clause"),
    (ISC, "ISC"),
    (APACHE, "Apache-2.0"),
    (GNU.format(stop=":", comma=",", kind="General Public License", version="3"), "GPL-3.0-or-later"),
    (GNU.format(stop=";", comma=";", kind="General Public License", version="2"), "GPL-2.0-or-later"),
    (GNU.format(stop=";", comma=";", kind="Lesser General Public\n# License", version="2.1"), "LGPL-2.1-or-later"),
    (GNU.format(stop=":", comma=",", kind="Affero General Public License", version="3"), "AGPL-3.0-or-later"),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nCopyright (C) 2007", "GPL-3.0-only"),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free", "Unlicense"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC-ND 3.0.", "CC-BY-NC-ND-3.0"),
    ("<!-- SPDX-License-Identifier: MPL-2.0 -->\ntext", "MPL-2.0"),
    ("# SPDX-License-Identifier: (MIT OR GPL-2.0+)\nimport x", "GPL-2.0-or-later,MIT"),
    ("This project is licensed under the terms of the MIT license.", "MIT"),
    ("This library is distributed under the GNU LGPLv2.1 or later.", "LGPL-2.1-or-later"),
    ("Some code, licensed under GPLv3+.", "GPL-3.0-or-later"),
    ("Available under the 3-Clause BSD License.", "BSD-3-Clause"),
    ("We license nothing here. The rights of readers are provided to all.", ""),
    ("Er kam mit der Lizenz. Mit.\nLicensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("He was licensed to drive a bus by the town, subject to review.", ""),
]


def test_real_licences(spark):
    rows = [(i, text) for i, (text, _) in enumerate(REAL)] + [(100, "x " * 200_000 + "\n" + MIT), (101, MIT + "\n\n" + APACHE)]
    df = spark.createDataFrame([(*r, "MIT", ["x"]) for r in rows], "doc_id long, text string, licences string, sentence_ids array<string>")
    out = {r.doc_id: ",".join(r.licences) for r in licences.scan(df).collect()}
    want = {i: name for i, (_, name) in enumerate(REAL)} | {100: "MIT", 101: "Apache-2.0,MIT"}
    assert out == want
    assert licences.scan(df.limit(0)).count() == 0


CHANGES = "op string, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long"


def test_rollup(spark):
    rollup = tokencounts.Rollup(spark, store.new_path(spark, "rollup"))
    assert rollup.totals().count() == 0
    load = spark.createDataFrame([("insert", "s", "en", "v1", 10, None), ("insert", "s", "en", "v1", 5, None), ("insert", None, None, "v1", None, None)], CHANGES)
    change = spark.createDataFrame([("delete", "s", "en", "v1", 5, None), ("revise", "s", "en", "v1", 12, 10), ("delete", None, None, "v1", 0, None)], CHANGES)
    assert rollup.commit("a", load) and not rollup.commit("a", load)
    assert rollup.commit("b", change) and not rollup.commit("b", load)
    read = lambda: [tuple(r) for r in rollup.totals().collect()]
    assert read() == [("s", "en", "v1", 1, 12)]
    rollup.compact()
    assert read() == [("s", "en", "v1", 1, 12)] and not rollup.commit("b", change)
    assert rollup.commit("c", load.limit(1)) and read() == [("s", "en", "v1", 2, 22)]
    rollup.compact()
    assert read() == [("s", "en", "v1", 2, 22)]
    assert rollup.commit("empty", load.limit(0)) and read() == [("s", "en", "v1", 2, 22)]
    with pytest.raises(ValueError):
        rollup.commit("../x", load)
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("bad", spark.createDataFrame([("upsert", "s", "en", "v1", 1, None)], CHANGES))


def test_unfinished_batches_do_not_count(spark):
    rollup = tokencounts.Rollup(spark, store.new_path(spark, "rollup"))
    df = spark.createDataFrame([("insert", "s", "en", "v1", 10, None)], CHANGES)
    rollup.commit("a", df)
    store.remove(spark, f"{rollup.path}/batches/a/_SUCCESS")
    assert rollup.totals().count() == 0
    assert rollup.commit("a", df) and rollup.totals().first().n_tokens == 10


def test_history_counts(spark):
    rows = [(1, "s", "en", "a b , c"), (2, "s", "en", "a b , c"), (3, "t", "en", None), (4, "t", None, "")]
    rollup = tokencounts.Rollup(spark, store.new_path(spark, "rollup"))
    for name, changes in tokencounts.history(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")).items():
        rollup.commit(name, changes)
    got = Counter({(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()})
    assert got["s", "en", "words-1"] == (1, 3) and got["s", "en", "runs-2"] == (1, 3) and got["t", "en", "words-1"] == (1, 0)
    assert ("t", None, "words-1") not in got  # the empty text is a copy of the null one


def test_history_equals_brute_force(spark):
    """Copies over sources, repeated rows of one id, null ids and very long texts."""
    rng = random.Random(8)
    texts = ["a b", "a b c , d", "", None, "x , y", "w " * 200_000]
    rows = [(rng.choice([None, *range(40)]), rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice(texts)) for _ in range(150)]
    rows = [(k, "s", "en", t) if k == 3 else (k, s, g, t) for k, s, g, t in rows]
    first = {}
    for k, _, _, t in rows:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    want = {}
    for k, s, g, t in rows:
        if k is None or k == first[t or ""]:
            words = (t or "").split()
            with_text = [w for w in words if any(c.isalnum() for c in w)]
            for name, n in (("words-1", len(with_text)), ("runs-2", len(with_text))):
                docs, tokens = want.get((s, g, name), (0, 0))
                want[s, g, name] = (docs + 1, tokens + n)
    rollup = tokencounts.Rollup(spark, store.new_path(spark, "rollup"))
    df = spark.createDataFrame([(*r, 5, "v") for r in rows], "doc_id long, source string, lang string, text string, n_tokens long, tokenizer string")
    for name, changes in tokencounts.history(df).items():
        rollup.commit(name, changes)
    assert {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == want


def test_notices_name_licences_and_people_do_not(spark):
    cases = [
        ("A new study published by MIT researchers shows it; see our license page", []),
        ("The telescope is used by MIT. A driving licence is needed", []),
        ("Data distributed by MIT Lincoln Lab; permission is required", []),
        ("The data is used under MIT supervision, see the license page", []),
        ("The book was published by GPL Press under license", []),
        ("This program is not licensed under the MIT License", []),
        ("This program isn't licensed under the MIT License", []),
        ("It is no longer distributed under the GNU GPL version 2", []),
        ("Released under MIT license", ["MIT"]),
        ("The code is licensed under MIT.", ["MIT"]),
        ("This work is covered by the MIT License", ["MIT"]),
        ("Use is governed by the Apache License, Version 2.0", ["Apache-2.0"]),
        ("Use is subject to the terms of the Mozilla Public License, version 2.0", ["MPL-2.0"]),
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option", ["Apache-2.0", "MIT"]),
        ("Released under the MIT license or the GNU GPL v2", ["GPL-2.0-only", "MIT"]),
        ("Licensed under the BSD 3-Clause and MIT licenses", ["BSD-3-Clause", "MIT"]),
        ("Distributed under the Common Development and Distribution License, Version 1.0", ["CDDL-1.0"]),
        ("Python is distributed under the Python Software Foundation License Version 2", ["PSF-2.0"]),
        ("CC0 1.0 Universal", ["CC0-1.0"]),
        (
            "# Licensed to the Apache Software Foundation (ASF) under one\n# or more contributor license agreements.  See the NOTICE file\n# distributed with this work for additional information\n"
            "# regarding copyright ownership.  The ASF licenses this file\n# to you under the Apache License, Version 2.0 (the\n# \"License\"); you may not use this file except in compliance\n# with the License.  You may obtain a copy of the License at\n",
            ["Apache-2.0"],
        ),
        (
            "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, "
            "including all related and neighboring rights, to the extent allowed by law.",
            ["CC0-1.0"],
        ),
    ]
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in licences.scan(docs).collect()}
    assert [(cases[i][0], got[i]) for i in range(len(cases)) if got[i] != cases[i][1]] == []


def test_two_licences_of_a_sentence_are_two_identifiers(spark):
    docs = spark.createDataFrame([(1, "Licensed under either of Apache License, Version 2.0 or MIT license at your option")], "doc_id long, text string")
    assert licences.scan(docs).first().sentence_ids == ["Ref:Apache-2.0", "Ref:MIT"]
