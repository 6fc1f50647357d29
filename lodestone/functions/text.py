"""Tokens, terms and excerpts as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of a question's terms (fixed values).
STOPWORDS = (
    "about after all and any are been but can could did does doc docs document documents file files find for from "
    "had has have how into its mention mentioned note notes not our said say says should show that the their them "
    "there they this those was were what when where which who why will with would you your"
).split()

MAX_QUERY_BYTES, MAX_TERMS, MAX_TERM_BYTES, QUESTION_TERMS = 4096, 32, 256, 12


def _folding() -> tuple[str, str]:
    """Accented Latin letters and the plain letters they decompose to."""
    accented, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _folding()


def folded(text: Column) -> Column:
    """Lower case without accents; texts of plain ASCII skip the letter table."""
    small = F.lower(text)
    return F.when(small.rlike(r"[^\x00-\x7F]"), F.translate(small, ACCENTED, PLAIN)).otherwise(small)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order, repeats kept."""
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def required_terms(query: Column) -> Column:
    """Terms that a strict search needs; an over-long query or term is an error."""
    bad = (F.octet_length(query) > MAX_QUERY_BYTES) | (F.size(tokens(query)) > MAX_TERMS) | F.exists(tokens(query), lambda t: F.octet_length(t) > MAX_TERM_BYTES)
    return F.when(bad, F.raise_error(F.lit("the query or one of its terms is too long"))).otherwise(F.array_distinct(tokens(query)))


def question_terms(query: Column) -> Column:
    """Distinct terms of a question that can tell documents apart, the first twelve."""
    words = F.transform(F.split(F.coalesce(query, F.lit("")), r"[^\p{L}\p{N}]+"), F.lower)
    kept = F.filter(words, lambda w: (F.char_length(w) >= 3) & (F.octet_length(w) <= 64) & ~w.isin(STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, QUESTION_TERMS)


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` bytes."""
    shrunk = F.when(F.octet_length(text) <= most, text)
    # a cut inside a character leaves a malformed end, which decoding marks; at most three bytes go
    tries = [F.substring(F.encode(text, "UTF-8"), 1, most - back) for back in range(4)]
    for t in tries:
        shrunk = F.coalesce(shrunk, F.when(F.is_valid_utf8(t.cast("string")), t.cast("string")))
    return shrunk


def excerpt(text: Column, most: int = 180) -> Column:
    """One line of at most ``most`` bytes, marked where it was cut."""
    line = collapsed(text)
    return F.when(F.octet_length(line) > most, F.concat(cut_bytes(line, most), F.lit("…"))).otherwise(line)


def matched_excerpt(text: Column, terms: Column, width: int = 16) -> Column:
    """``width`` words around the first word that is a term; the opening if none is."""
    words = F.split(collapsed(text), " ")
    hit = F.array_position(F.transform(words, lambda w: F.arrays_overlap(tokens(w), terms)), True)
    start = F.greatest(F.lit(1), hit - width // 2).cast("int")
    part = F.array_join(F.slice(words, start, width), " ")
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(""), part, F.when(F.size(words) >= start + width, F.lit("…")).otherwise(""))


def prefix_words(text: Column, most: int = 1200) -> Column:
    """White-space-normalised prefix that ends at a word's end, within ``most`` bytes."""
    line = collapsed(text)
    whole = F.octet_length(line) <= most
    head = cut_bytes(line, most)
    return F.when(whole, line).when(F.substring(line, F.char_length(head) + 1, F.lit(1)) == " ", head).otherwise(F.coalesce(F.nullif(F.regexp_replace(head, r" [^ ]*$", ""), F.lit("")), head))


def embedding_input(heading: Column, text: Column) -> Column:
    """Heading (256 characters) over text (4096 characters)."""
    return F.concat(F.substring(heading, 1, 256), F.lit("\n"), F.substring(text, 1, 4096))


def citation(title: Column, extension: Column, page: Column, line: Column) -> Column:
    """Title with the place in the file: slide, page or line."""
    place = F.when((page > 0) & (extension == "pptx"), F.concat(F.lit(" · slide "), page)).when(page > 0, F.concat(F.lit(" · p. "), page)).when(line > 1, F.concat(F.lit(" · line "), line))
    return F.concat(title, F.coalesce(place, F.lit("")))


def human_bytes(n: Column) -> Column:
    """1234567 as 1.2 MB."""
    scaled = lambda power, unit: F.concat(F.format_number(n / 1000**power, 1), F.lit(f" {unit}"))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < 10**6, scaled(1, "KB")).when(n < 10**9, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def link_host(url: Column) -> Column:
    """Host of an http(s) link without www."""
    return F.regexp_replace(F.regexp_extract(url, r"^https?://([^/?#:]+)", 1), r"^www\.", "")


def short_path(path: Column, home: str) -> Column:
    """The folder of a path, home written as ~."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return F.regexp_replace(folder, f"^{re.escape(home)}(?=/|$)", "~")


def extension_of(path: Column) -> Column:
    """Lower-case extension of the last path component; empty where there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def flattened_clip(text: Column, most: int = 500) -> Column:
    """Searchable form of a clip: one line, 500 characters; null if nothing is left."""
    return F.nullif(F.substring(collapsed(text), 1, most), F.lit(""))


def without_controls(text: Column) -> Column:
    """Text without ANSI escapes and control characters other than tab and newline."""
    return F.regexp_replace(F.regexp_replace(text, "\\x1B\\[[0-?]*[ -/]*[@-~]", ""), r"[\x00-\x08\x0B-\x1F\x7F]", "")


#: Words never marked in a passage (fixed values).
UNMARKED = set("documents about content docs find files the and for".split())


def marked_ranges(text: str, query: str, most: int = 128) -> list[tuple[int, int]]:
    """(start, length) of the query's words in a passage, accents and case aside, by start; 128 at most."""
    plain = "".join(unicodedata.normalize("NFD", c)[0].lower()[:1] or c for c in text)
    words = [w.lower() for part in query.split() if ":" not in part for w in re.findall(r"[^\W_]+", part)]
    words = [w for w in words if 2 <= len(w) <= 64 and w not in UNMARKED][:32]
    out: list[tuple[int, int]] = []
    for word in sorted(set(words)):
        wanted = "".join(unicodedata.normalize("NFD", c)[0] for c in word)
        for m in re.finditer(re.escape(wanted), plain):
            if len(out) == most:
                break
            out.append((m.start(), len(wanted)))
    return sorted(out)


def valid_keyword(keyword: Column) -> Column:
    return keyword.rlike("^[a-z0-9_-]{1,32}$")


def valid_link(url: Column, most: int = 2048) -> Column:
    """A web address without white space or control characters."""
    return (F.octet_length(url) <= most) & url.rlike(r"^https?://[^\s\p{Cntrl}]+$")


#: Word sets of the calendar question test (fixed values).
CALENDAR_SUBJECTS = "calendar calendars schedule agenda meeting meetings appointment appointments events".split()
CALENDAR_EXCLUDED = (
    "notes note file files document documents doc docs pdf transcript recording email summarize summary create add book cancel delete move "
    "reschedule invite remind reminder set port"
).split()
CALENDAR_CUES = "today tomorrow tonight morning afternoon evening next upcoming now left anything something smth any have got what's whats when busy free my".split()


def asks_about_calendar(text: Column) -> Column:
    """A calendar word and a time cue, no word about files or changes, and not the order to schedule something."""
    plain = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), "^>", ""))
    words = F.split(plain, r"[^\p{L}\p{N}']+")
    has = lambda those: F.arrays_overlap(words, F.array(*map(F.lit, those)))
    return (plain != "") & (F.octet_length(plain) <= 160) & has(CALENDAR_SUBJECTS) & ~has(CALENDAR_EXCLUDED) & has(CALENDAR_CUES) & ~plain.rlike("^schedule (a|an|the|with) |^schedule time")


def is_private_clip(types: Column, markers: list[str]) -> Column:
    """A clip that carries any of the privacy markers is not kept."""
    return F.arrays_overlap(types, F.array(*map(F.lit, markers)))
