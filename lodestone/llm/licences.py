"""Sentence-rule licence recognition, in DataFrame functions only.

A text's comment marks are taken off, its wrapped lines joined and its sentences cut; each sentence is
normalised (lower case, version digits kept, everything else one space) and mapped to the identifier of a known
licence sentence. Sentences that refer to a licence by name ("released under the ...", a title, an SPDX tag)
map to ``Ref:`` and the licence, or to two of them where a notice offers two. Each document's identifiers, in order, are matched against ordered rules:
longer rules stand first and take their sentences, so a text is named by the most that it says.

Only texts with a word that some sentence or name must have are cut, and only recognised sentences leave the expression, so nothing is
grouped or shuffled. Lines are looked up alone where the sentence around them is not known, or where
several of them are.

Defined cases: null, empty and unlicensed texts give an empty list and status ``none``; sentences known but
in no rule's order give status ``unknown``; of rules that match equally the first on the list takes the sentences;
a plain reservation of rights that does not lead into a licence's own words counts as ``Proprietary``; texts of any length are scanned whole; an
empty table gives no rows; repeated rows give repeated results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(sentence: str) -> str:
    """The form in which sentences are compared."""
    return " ".join(re.sub(r"[^a-z0-9.]+|\.(?![0-9])", " ", sentence.lower()).split())


# Sentences of the licences' own texts and notices, with the identifiers they have here.
SENTENCES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "MitGrant",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so": "Mit0Grant",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "MitGrant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "MitNotice",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "AsIs",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ZeroBsdGrant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BsdGrant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BsdSource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BsdBinary",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement": "BsdAdvert",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "Released under the MIT License": "MitRef",
    "Licensed under the MIT License": "MitRef",
    "Licensed under the Apache License, Version 2.0": "Apache2Ref",
    "Licensed under the Apache License, Version 2.0 (the \"License\")": "Apache2Ref",
    "You may not use this file except in compliance with the License": "Apache2Comply",
    "You may obtain a copy of the License at": "Apache2Copy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "Apache2Basis",
    "Apache License Version 2.0, January 2004": "Ref:Apache-2.0",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses": "Ref:Apache-2.0",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "GplTerms",
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "LgplTerms",
    "You can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation": "LgplTerms",
    "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "AgplTerms",
    "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0": "Ref:MPL-2.0",
    "This is free and unencumbered software released into the public domain": "Ref:Unlicense",
    "This software is provided 'as-is', without any express or implied warranty": "ZlibAsIs",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "ZlibGrant",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following": "BoostGrant",
    "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law": "Ref:CC0-1.0",
    "All rights reserved": "AllRights",
}

# Names by which notices and titles call licences, normalised.
NAMES = {
    "mit license": "MIT",
    "mit licence": "MIT",
    "expat license": "MIT",
    "mit": "MIT",
    "isc license": "ISC",
    "apache license version 2.0": "Apache-2.0",
    "apache license version 2": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "apache licence version 2.0": "Apache-2.0",
    "apache software license version 2.0": "Apache-2.0",
    "apache version 2.0": "Apache-2.0",
    "apache 2.0": "Apache-2.0",
    "apache 2": "Apache-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 2 clause": "BSD-2-Clause",
    "2 clause bsd license": "BSD-2-Clause",
    "simplified bsd license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "bsd 3 clause": "BSD-3-Clause",
    "3 clause bsd license": "BSD-3-Clause",
    "new bsd license": "BSD-3-Clause",
    "modified bsd license": "BSD-3-Clause",
    "mozilla public license version 2.0": "MPL-2.0",
    "mozilla public license 2.0": "MPL-2.0",
    "mpl version 2.0": "MPL-2.0",
    "mpl 2.0": "MPL-2.0",
    "eclipse public license version 2.0": "EPL-2.0",
    "eclipse public license 2.0": "EPL-2.0",
    "eclipse public license version 1.0": "EPL-1.0",
    "boost software license version 1.0": "BSL-1.0",
    "boost software license": "BSL-1.0",
    "zlib license": "Zlib",
    "unlicense": "Unlicense",
    "wtfpl": "WTFPL",
    "artistic license 2.0": "Artistic-2.0",
    "artistic license version 2.0": "Artistic-2.0",
    "european union public licence version 1.2": "EUPL-1.2",
    "sil open font license version 1.1": "OFL-1.1",
    "open database license": "ODbL-1.0",
    "creative commons zero": "CC0-1.0",
    "cc0 1.0 universal": "CC0-1.0",
    "cc0 1.0": "CC0-1.0",
    "cc0": "CC0-1.0",
    "common development and distribution license version 1.0": "CDDL-1.0",
    "common development and distribution license version 1.1": "CDDL-1.1",
    "common development and distribution license": "CDDL-1.0",
    "cddl version 1.0": "CDDL-1.0",
    "cddl 1.0": "CDDL-1.0",
    "python software foundation license version 2": "PSF-2.0",
    "python software foundation license": "PSF-2.0",
    "psf license": "PSF-2.0",
}


@dataclass(frozen=True)
class LicenceRule:
    """A licence and the identifiers that show it, in this order, next to each other."""

    licence: str
    sequence: tuple[str, ...]


_GNU = {"GplTerms": ("GPL", ("2", "3")), "LgplTerms": ("LGPL", ("2", "2.1", "3")), "AgplTerms": ("AGPL", ("3",))}
_full = lambda v: v if "." in v else f"{v}.0"

_FAMILIES = (
    LicenceRule("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse")),
    LicenceRule("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert")),
    LicenceRule("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    LicenceRule("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    *(LicenceRule("Apache-2.0", (ref, *more)) for ref in ("Apache2Ref", "Ref:Apache-2.0") for more in (("Apache2Comply", "Apache2Copy", "Apache2Basis"), ("Apache2Comply", "Apache2Copy"), ("Apache2Comply",), ())),
    LicenceRule("MIT", ("MitRef",)),
    LicenceRule("MIT", ("MitGrant", "MitNotice", "AsIs")),
    LicenceRule("MIT", ("MitGrant", "MitNotice")),
    LicenceRule("MIT", ("MitGrant",)),
    LicenceRule("MIT-0", ("Mit0Grant", "AsIs")),
    LicenceRule("MIT-0", ("Mit0Grant",)),
    LicenceRule("ISC", ("IscGrant",)),
    LicenceRule("0BSD", ("ZeroBsdGrant",)),
    LicenceRule("Zlib", ("ZlibAsIs", "ZlibGrant")),
    LicenceRule("BSL-1.0", ("BoostGrant",)),
    *(LicenceRule(f"{name}-{_full(v)}-or-later", (terms, f"Later{v}")) for terms, (name, versions) in _GNU.items() for v in versions),
    *(LicenceRule(f"{name}-{_full(v)}-only", (terms, f"Only{v}")) for terms, (name, versions) in _GNU.items() for v in versions),
)
#: Longer rules stand before those they contain; a ``Ref:`` that no rule took names its licence by itself.
#: A reservation of rights right before a licence's own words belongs to its copyright line.
RULES = tuple(sorted((*_FAMILIES, *(LicenceRule(r.licence, ("AllRights", *r.sequence)) for r in _FAMILIES if r.sequence[0].endswith(("Grant", "Terms", "AsIs")))), key=lambda r: -len(r.sequence)))

#: Marks of comments and lists at the start of a line, and comment ends.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+!?|#+|;+|--+|%+|<!--|dnl\b|REM\b|[-•])[ \t]*|[ \t]*(?:\*/|-->)[ \t]*$"
#: An SPDX tag is a sentence of its own, whatever follows it.
SPDX = r"SPDX-License-Identifier:[ \t]*([^\n]*)"
VERSION = r"(?i)(?:\b|(?<=GPL))v(?:er)?\.?[ \t]*(?=[0-9])"
#: A sentence ends at . ! ? ; : before white space or the end, or at a line without letters or digits; a single newline only wraps it.
BREAK = r"\n[^\p{L}\p{N}\n]*(?=\n)|[.!?;:]+[\"')\]]*(?=\s|$)"
TRIGGER = r"(?i)licen[sc]e|rights[^\p{L}\p{N}]+reserved|permission[^\p{L}\p{N}]+(?:is|to)\b|redistribution|either[^\p{L}\p{N}]+version|public[^\p{L}\p{N}]+domain|creative[^\p{L}\p{N}]+commons|\bcc[^\p{L}\p{N}]by|spdx|\bcc0\b|\b[al]?gpl"
#: Any text that can hold a known sentence or name has one of these, too: they, not a guess, decide what is cut.
#: Words of sentences and names that TRIGGER doesn't have; of its own it has those of the GNU and Commons names.
WORDS = r"advertising|endorse|as[^\p{L}\p{N}]+is\b|mention|retain|reproduce|redistribute|permission|without[^\p{L}\p{N}]+warranty|unencumbered|subject[^\p{L}\p{N}]+to|waiving|compliance|mozilla|apache|(?<![\p{L}\p{N}])mpl|(?<![\p{L}\p{N}])bsd|(?<![\p{L}\p{N}])isc(?![\p{L}\p{N}])|eclipse|boost|zlib|wtfpl|artistic|open[^\p{L}\p{N}]+database|python[^\p{L}\p{N}]+software|common[^\p{L}\p{N}]+development|cddl|(?<![\p{L}\p{N}])psf|general[^\p{L}\p{N}]+public"
#: "mit" is a word of other languages: it names a licence after a notice only.
NOTICED = r"(?s)\A(?=.*?(?:under|by|subject|licen[sc]es)[^\p{L}\p{N}]).*?(?<![\p{L}\p{N}])mit(?![\p{L}\p{N}])"

#: What may stand before a licence's first words without a stop: a title and a copyright line.
LEAD = r"^.+? (?=permission is hereby granted |permission to use copy |redistribution and use in |this source code form is |this is free and unencumbered )"

_either = lambda names: "|".join(re.escape(n).replace(r"\ ", " ") for n in sorted(names, key=len, reverse=True))
_names = _either(NAMES)
#: Words that turn a notice round.
NEGATED = "".join(rf"(?<!\b{w} )" for w in ("not", "not be", "not been", "never", "never been", "no longer", "cannot be", "isn t", "wasn t", "aren t", "nor", "not currently", "not yet"))
#: Words that come between "licensed" and a name. Works are covered *by* a licence, but published *by* people.
NOTICE = rf"\b{NEGATED}(?:(?:licen[sc]ed|released|distributed|available|published|provided|shared|issued|covered|governed|used|redistribute it and or modify it)(?: only| freely)? under|(?:covered|governed) by|subject to|licen[sc]es this (?:file|work|software|program|project)(?: to you)? under)(?: either)?(?: of)?(?: the| a| an)?(?: terms(?: and conditions)? of(?: either)?(?: of)?(?: the| a| an)?)? (.+)$"
#: A name of one word is also a name of people and places: it must end there or say that it is a licence.
_loose, _bare = _either(n for n in NAMES if " " in n), _either(n for n in NAMES if " " not in n)
NAMED = rf"^(?:the )?(?:({_loose})(?: |$)|({_bare})(?= licen[sc]es?\b| or | and |$))"
#: The second of two licences.
SECOND = rf"^(?:the )?(?:{_names}|(?:gnu )?(?:(?:lesser |library |affero )?general public|[al]?gpl)(?: licen[sc]e)?(?: version)?(?: [1-3](?:\.[01])?)?(?: or later)?)(?: licen[sc]es?)?(?: or| and)(?: under)?(?: the| a| an)? (.+)$"
#: A name alone is a title only if it is of several words: "mit" is also a word of other languages.
TITLE = rf"^(?:the )?({_either(n for n in NAMES if ' ' in n)})(?: mit)?$"
GNU = r"^(?:the )?(?:gnu )?((?:lesser |library |affero )?general public|[al]?gpl)(?: licen[sc]e)?(?: as published by the free software foundation)?(?: either)?(?: version)?(?: ([1-3](?:\.[01])?))?( only)?( of the license)?( or (?:at your option )?(?:any )?(?:later|newer|above))?"
GNU_TITLE = r"^(?:the )?gnu (?:lesser |library |affero )?general public licen[sc]e(?: version [1-3](?:\.[01])?)?(?: or (?:any )?later(?: version)?)?(?: \d+ \p{L}+ \d{4})?$"
COMMONS = r"^(?:the |a )?(?:creative commons attribution|cc by)((?: non ?commercial| no ?derivs?| no ?derivatives?(?: works)?| share ?alike| nc| nd| sa)*)(?: license)?(?: version)? ([1-4]\.[0-9])"


def _folded(s: Column) -> Column:
    """``normalised`` as a Column."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}.]+|\.(?!\p{N})", " "), " +", " "))


def _gnu(rest: Column) -> Column:
    """Licence of a text that starts with a GNU licence's name, else null."""
    part = lambda i: F.regexp_extract(rest, GNU, i)
    kind = F.when(part(1).rlike("^(lesser|library|lgpl)"), "LGPL").when(part(1).rlike("^(affero|agpl)"), "AGPL").otherwise("GPL")
    version = F.when(part(2) == "", "1.0").when(F.contains(part(2), F.lit(".")), part(2)).otherwise(F.concat(part(2), F.lit(".0")))
    later = (part(5) != "") | (part(2) == "")
    return F.when(rest.rlike(GNU), F.concat(kind, F.lit("-"), version, F.when(later, "-or-later").otherwise("-only")))


def _commons(rest: Column) -> Column:
    """Licence of a text that starts with a Creative Commons name, else null."""
    kind = F.regexp_extract(rest, COMMONS, 1)
    flag = lambda pattern, name: F.when(kind.rlike(pattern), name).otherwise("")
    return F.when(rest.rlike(COMMONS), F.concat(F.lit("CC-BY"), flag(" non ?commercial| nc", "-NC"), flag(" share ?alike| sa", "-SA"), flag(" no ?deriv| nd", "-ND"), F.lit("-"), F.regexp_extract(rest, COMMONS, 2)))


#: Between the two identifiers of a sentence that offers two licences.
TWO = ";;"


def _by_name(rest: Column, names: Column) -> Column:
    """Licence of a text that starts with a licence's name, else null."""
    found = F.concat(F.regexp_extract(rest, NAMED, 1), F.regexp_extract(rest, NAMED, 2))
    return F.try_element_at(names, F.nullif(found, F.lit("")))


def _reference(s: Column, names: Column) -> Column:
    """``Ref:`` and the licence that a normalised sentence refers to by name, or two of them; else null."""
    rest = F.regexp_extract(s, NOTICE, 1)
    first = F.get(F.transform(F.array(rest), lambda r: F.coalesce(_by_name(r, names), _gnu(r), _commons(r))), F.lit(0))
    second = F.get(F.transform(F.array(F.regexp_extract(rest, SECOND, 1)), lambda r: F.coalesce(_by_name(r, names), _gnu(r))), F.lit(0))
    title = F.coalesce(F.try_element_at(names, F.nullif(F.regexp_extract(s, TITLE, 1), F.lit(""))), F.when(s.rlike(GNU_TITLE), _gnu(s)), _commons(s))
    both = F.concat(F.lit("Ref:"), first, F.coalesce(F.concat(F.lit(f"{TWO}Ref:"), F.nullif(second, first)), F.lit("")))
    return F.coalesce(both, F.concat(F.lit("Ref:"), title))


def _tagged(s: Column) -> Column:
    """Identifiers of an SPDX expression: one for each licence it names."""
    # a plus was spelled out with the text's other versions
    ids = F.split(F.regexp_replace(F.regexp_replace(F.replace(s, F.lit(" or later"), F.lit("-or-later")), r"(?i)^\s*SPDX-License-Identifier\s*|[()]|\s+WITH\s+\S+", " "), r"^\s+|\s+$", ""), r"\s+(?:OR|AND)\s+")
    return F.transform(ids, lambda x: F.when(x.rlike(r"^[0-9A-Za-z][0-9A-Za-z.+-]*$"), F.concat(F.lit("Ref:"), x)))


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order; null where the text has no trigger word."""
    pairs = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    low = F.lower(text)
    known, names = pairs({normalised(k): v for k, v in SENTENCES.items()}), pairs(NAMES)
    clean = F.regexp_replace(F.regexp_replace(text, MARKS, ""), SPDX, "\n\nSPDX-License-Identifier $1\n\n")
    clean = F.regexp_replace(F.regexp_replace(clean, VERSION, " version "), r"(?<=[0-9])\+(?=[^0-9A-Za-z]|$)", " or later")

    def of(s: Column) -> Column:
        """Identifier of one sentence or line."""
        n = F.regexp_replace(_folded(s), r"^neither the name of .+ nor the names of (?:its|his|her|the|their) contributors", "neither the name of the copyright holder nor the names of its contributors")
        return F.get(F.transform(F.array(n), named), F.lit(0))

    def named(n: Column) -> Column:
        later = F.nullif(F.regexp_extract(n, r"^either version ([23](?:\.1)?)(?:\.0)? of the license or at your option any later version$", 1), F.lit(""))
        only = F.nullif(F.regexp_extract(n, r"^version ([23](?:\.1)?)(?:\.0)? of the license$", 1), F.lit(""))
        return F.coalesce(F.try_element_at(known, n), F.try_element_at(known, F.regexp_replace(n, LEAD, "")), F.concat(F.lit("Later"), later), F.concat(F.lit("Only"), only), _reference(n, names), F.when(n.rlike(r"(?:^| )all rights reserved$"), "AllRights"))

    # a wrapped sentence counts whole, unless several of its lines are known by themselves
    def ids_of(s: Column) -> Column:
        lines = F.when(F.contains(s, F.lit("\n")), F.split(s, "\n")).otherwise(F.array().cast("array<string>"))
        each = F.filter(F.transform(lines, of), lambda x: x.isNotNull())
        pick = lambda pair: F.when((F.size(pair.each) > 1) | (F.get(pair.whole, F.lit(0)).isNull()), pair.each).otherwise(pair.whole)
        both = F.array(F.struct(F.transform(F.array(s), of).alias("whole"), each.alias("each")))
        return F.when(F.contains(s, F.lit("SPDX-License-Identifier")), _tagged(s)).otherwise(F.flatten(F.transform(both, pick)))

    triggered = F.when(text.rlike(f"{TRIGGER}|{WORDS}") | low.rlike(NOTICED), clean)
    found = F.filter(F.flatten(F.transform(F.split(triggered, BREAK), ids_of)), lambda x: x.isNotNull())
    return F.flatten(F.transform(found, lambda x: F.split(x, TWO)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids array, licences array, status) per row of docs(doc_id, text)."""
    none = F.array().cast("array<string>")
    found = docs.select("doc_id", F.coalesce(sentence_ids(F.col("text").cast("string")), none).alias("sentence_ids"))
    # identifiers become one string ";A;;B;"; a rule found there gives its name and takes its part out
    rules = F.array(*[F.struct(F.lit("".join(f";{x};" for x in r.sequence)).alias("part"), F.lit(r.licence).alias("licence")) for r in RULES])
    begin = F.struct(F.concat(F.lit(";"), F.array_join("sentence_ids", ";;"), F.lit(";")).alias("rest"), none.alias("got"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc.rest, rule.part)
        return F.struct(F.when(hit, F.replace(acc.rest, rule.part, F.lit(";-;"))).otherwise(acc.rest).alias("rest"), F.when(hit, F.array_append(acc.got, rule.licence)).otherwise(acc.got).alias("got"))

    def licences(acc: Column) -> Column:
        refs = F.transform(F.filter(F.split(acc.rest, ";"), lambda x: F.startswith(x, F.lit("Ref:"))), lambda x: F.substring(x, 5, 1 << 20))
        reserved = F.when(F.contains(acc.rest, F.lit(";AllRights;")), F.array(F.lit("Proprietary"))).otherwise(none)
        return F.array_sort(F.array_distinct(F.concat(acc.got, refs, reserved)))

    named = F.when(F.size("sentence_ids") == 0, none).otherwise(F.aggregate(rules, begin, step, licences))
    out = found.select("doc_id", "sentence_ids", named.alias("licences"))
    status = F.when(F.size("sentence_ids") == 0, "none").when(F.size("licences") == 0, "unknown").when(F.size("licences") == 1, "single").otherwise("multiple")
    return out.select("doc_id", "sentence_ids", "licences", status.alias("status"))
