"""Passages of a text, by its shape: prose, paged, sections or code. Lengths are UTF-8 bytes."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby, islice, pairwise
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import extension_of

#: Unicode white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

#: Words that begin a declaration, words that bind a name, and modifiers before either (fixed values).
DECLARING = set("fn func function def class struct enum impl trait interface module package protocol extension object record namespace macro_rules! sub proc".split())
BINDING = set("const let var val static type".split())
MODIFIERS = set("pub pub(crate) public private protected internal export default async static final override open abstract unsafe extern inline declare @objc @main #[derive]".split())
CODE_EXTENSIONS = "rs swift py js jsx ts tsx go java c h cpp hpp rb sh sql css".split()
_ASCII_LOWER = bytes(range(256)).lower()


@dataclass(frozen=True)
class Limits:
    """Sizes of passages, and ceilings of bytes and passages of a text, which has none unless they are given."""

    target: int = 1000
    overlap: int = 150
    max_bytes: int | None = None
    max_chunks: int | None = None


def size(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode())


def head(s: str, most: int) -> str:
    """Longest prefix within ``most`` bytes."""
    return s[:most] if s.isascii() else s.encode()[:most].decode("utf-8", "ignore")


def tail(s: str, most: int) -> str:
    """Longest suffix within ``most`` bytes."""
    if s.isascii():
        return s[-most:] if most else ""
    raw = s.encode()
    at = max(0, len(raw) - most)
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return raw[at:].decode()


def lines(text: str) -> list[str]:
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def heading_level(line: str) -> int:
    """1 to 6 for a Markdown heading with words, else 0."""
    found = re.match(r"#{1,6}(?!#)", line)
    return len(found[0]) if found and line[found.end() :].strip(SPACE) else 0


def split_identifier(name: str) -> list[str]:
    """Words of an identifier: at underscores, and before a capital that follows a small letter."""
    marked = "".join("_" * (c.isupper() and not before.isupper()) + c for before, c in zip("_" + name, name))
    return [w for w in marked.split("_") if w]


def symbols(text: str, most: int = 2000) -> str:
    """Distinct words of the identifiers in a text, in order, within ``most`` bytes."""
    names = (n for n in re.findall(r"\w+", text) if 3 <= size(n) <= 64 and any(c == "_" or c.isupper() for c in n))
    parts = (p.encode().translate(_ASCII_LOWER).decode() for n in names for p in split_identifier(n) if size(p) >= 2)
    words = list(dict.fromkeys(parts))
    # a word costs its bytes and a space, but for the last one's
    room = bisect_right(list(accumulate(size(w) + 1 for w in words)), most + 1)
    return " ".join(words[:room])


class Paragraph(NamedTuple):
    line: int
    heading: str
    text: str


def paragraphs(text: str) -> Iterator[Paragraph]:
    """Runs of lines between blank lines and headings, with the headings they stand under."""
    rows = ((n, line, heading_level(line.strip(SPACE))) for n, line in enumerate(lines(text), 1))
    path = {}
    for kind, group in groupby(rows, key=lambda r: "heading" if r[2] else "text" if r[1].strip(SPACE) else "blank"):
        group = list(group)
        if kind == "heading":
            for _, line, level in group:
                # a heading closes those of its level and below
                path = {k: v for k, v in path.items() if k < level} | {level: line.strip(SPACE).lstrip("#").strip(SPACE)}
        elif kind == "text":
            yield Paragraph(group[0][0], " > ".join(path.values()), "".join(line.rstrip(SPACE) + "\n" for _, line, _ in group))


def overlap(text: str, most: int) -> str:
    """What a passage repeats of the one before: its last bytes from a sentence's or word's start."""
    if not most or size(text) <= most:
        return ""
    end = tail(text, most)
    cut = re.search(r"\. ", end) or re.search(" ", end)
    end = end[cut.end() :] if cut else end
    return re.sub(r"([^\n])\Z", r"\1\n", end)


def walls(text: str, target: int) -> Iterator[str]:
    """Prefixes of about the target, at character boundaries, and the rest once it is within twice the target."""
    raw, at = text.encode(), 0
    while len(raw) - at > 2 * target:
        end = at + target
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        if end <= at:
            raise ValueError(f"a character is longer than the target of {target} bytes")
        yield raw[at:end].decode()
        at = end
    yield raw[at:].decode()


def pack(blocks: Iterable[Paragraph], limits: Limits) -> Iterator[tuple[str, int, str]]:
    """(heading, line, text) of passages of whole paragraphs up to the target.

    A passage that begins with an overlap keeps the heading of the passage before, but has the line of its
    first own paragraph. A paragraph beyond twice the target is cut at the target.
    """
    carry, heading, left = "", "", iter(blocks)
    first = next(left, None)
    while first:
        heading = heading if carry.strip(SPACE) else first.heading
        *cut, text = walls(carry + first.text, limits.target)
        yield from ((heading, first.line, wall) for wall in cut)
        # as many further paragraphs as the target has room for
        parts, room = [text], limits.target - size(text)
        while (following := next(left, None)) and (room := room - size(following.text)) >= 0:
            parts.append(following.text)
        text = "".join(parts)
        yield heading, first.line, text
        first, carry = following, overlap(text, limits.overlap)


def declares(line: str) -> bool:
    """A line that opens a declaration, at most four columns in; a binding counts at the margin only."""
    bare = line.lstrip(SPACE)
    indent = size(line) - size(bare)
    word = next((w for w in bare.lower().split() if w.rstrip(":") not in MODIFIERS), "").rstrip("(:")
    return indent <= 4 and word in (DECLARING if indent else DECLARING | BINDING)


def headline(line: str) -> str:
    return head(line.strip(SPACE).rstrip("{:;").strip(SPACE), 100)


def code_cuts(sizes: list[int], declared: list[int], target: int) -> list[int]:
    """Line numbers (from 0) where passages begin, and the end.

    A passage ends before the first declaration once it has half the target or 20 lines, or when it outgrows
    twice the target.
    """
    ends = list(accumulate(sizes, initial=0))
    cuts = [0]
    while cuts[-1] < len(sizes):
        at = cuts[-1]
        ripe = max(at + 1, min(bisect_left(ends, ends[at] + target / 2), at + 20))
        following = bisect_left(declared, ripe)
        full = bisect_right(ends, ends[at] + 2 * target)
        cuts.append(min(full, len(sizes), declared[following] if following < len(declared) else len(sizes)))
    return cuts


def code_passages(text: str, limits: Limits) -> Iterator[tuple[str, int, str]]:
    """(heading, line, text) of passages of code; one that starts inside a declaration is named by it."""
    rows = lines(text)
    declared = [i for i, line in enumerate(rows) if declares(line)]
    cuts = code_cuts([size(x) + 1 for x in rows], declared, limits.target)
    opened = ""
    for begin, end in pairwise(cuts):
        own = declared[bisect_left(declared, begin) : bisect_left(declared, end)]
        first = next((i for i in range(begin, end) if rows[i].strip(SPACE)), end)
        inherited = opened if first == begin and begin not in own else ""
        yield inherited or (headline(rows[own[0]]) if own else ""), first + 1, "".join(x + "\n" for x in rows[begin:end])
        opened = headline(rows[own[-1]]) if own else ""


def _pieces(kind: str, text: str, limits: Limits) -> Iterator[tuple[int, str, int, str]]:
    """(page, heading, line, text) of all passages of a text, blank ones too; page 0 where there are none."""
    if kind in ("prose", "paged", "sections"):
        for n, part in enumerate(text.split("\f") if kind != "prose" else [text], 1):
            yield from ((n if kind == "paged" else 0, *p) for p in pack(paragraphs(part), limits))
    elif kind == "code":
        yield from ((0, *p) for p in code_passages(text, limits))
    else:
        raise ValueError(f"unknown kind {kind!r}")


def passages(kind: str, text: str, limits: Limits = Limits()) -> Iterator[tuple]:
    """(ordinal, page, line, heading, text, symbols) of a whole text, one at a time; ceilings are left to ``chunks``."""
    found = ((page, 0 if page else line, heading, body.strip(SPACE)) for page, heading, line, body in _pieces(kind, text, limits))
    yield from ((n, *x, symbols(x[3])) for n, x in enumerate(x for x in found if x[3]))


def chunks(kind: str, text: str, limits: Limits = Limits()) -> tuple[list[tuple], bool]:
    """[(ordinal, page, line, heading, text, symbols)] and whether a ceiling cut the text."""
    short = text if limits.max_bytes is None else head(text, limits.max_bytes)
    found = passages(kind, short, limits)
    out = list(islice(found, limits.max_chunks))
    return out, next(found, None) is not None or len(short) < len(text)


def kind_of(path: Column, extracted: Column) -> Column:
    """Shape of a file by its extension; page shapes only if its text was extracted."""
    ext = extension_of(path)
    return F.when(extracted & (ext == "xlsx"), "sections").when(extracted & ext.isin("pdf", "pptx"), "paged").when(ext.isin(CODE_EXTENSIONS), "code").otherwise("prose")


#: Characters of texts whose passages a task holds before it sends them on.
HELD_CHARS = 1 << 20
CHUNK_SCHEMA = "document_id {id}, ordinal int, page int, line int, heading string, text string, symbols string, truncated boolean"


def chunked(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Passages of docs(document_id, kind, body), made where the rows are: no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["document_id", "ordinal", "page", "line", "heading", "text", "symbols", "truncated"]
        for f in frames:
            rows, held = [], 0
            for key, kind, body in zip(f["document_id"], f["kind"], f["body"]):
                # whether a ceiling cuts a text is known at its end, so only whole texts are sent on in parts
                whole = limits.max_bytes is None and limits.max_chunks is None
                parts, cut = (passages(kind, body or "", limits), False) if whole else chunks(kind, body or "", limits)
                for p in parts:
                    rows.append((key, *p, cut))
                    held += len(p[4])
                    if held >= HELD_CHARS:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    return docs.select("document_id", "kind", "body").mapInPandas(run, CHUNK_SCHEMA.format(id=docs.schema["document_id"].dataType.simpleString()))


def with_ocr_heading(passages: DataFrame, ocr_pages: Column) -> DataFrame:
    """Headings of pages that were read by OCR say so."""
    return passages.withColumn("heading", F.when(F.array_contains(ocr_pages, F.col("page")), F.concat(F.lit("Read by OCR · "), "heading")).otherwise(F.col("heading")))


def sentence_passages(text: str, most_bytes: int = 480, most: int = 12) -> list[str]:
    """Sentences packed up to a size, the first twelve packs."""
    out: list[str] = []
    now = ""
    for part in (p.strip(SPACE) for p in re.split(r"(?<=[.!?\n])", text)):
        if part:
            if now and size(now) + size(part) + 1 > most_bytes:
                out.append(now)
                now = ""
            now = f"{now} {part}" if now else part
    return [*out, *([now] if now else [])][:most]
