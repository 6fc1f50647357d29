"""File scans: text decoding, office archives, and the document table."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import cut_bytes
from lodestone.operators.filters import DOCUMENT_EXTENSIONS, TEXT_EXTENSIONS, collapsed_paths, excluded, indexable, scope_predicate

MAX_TEXT, BODY = 2 << 20, 64 << 10


def files(spark: SparkSession, root: str, scope: list[str] | None = None) -> DataFrame:
    """(path, modified_ns, bytes, content) below a folder.

    Unsupported extensions are left out of the listing, so their content is never read. Excluded folders and paths
    out of scope are filtered by path, which the reader can't push down: they are read but go before any decoding.
    """
    # a glob of the extensions in either case
    either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in [*TEXT_EXTENSIONS, *DOCUMENT_EXTENSIONS]]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(either) + "}").load(root)
    local = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    base = re.sub("^[a-z]+:/*(?=/)", "", root).rstrip("/")
    inside = F.substring(local, len(base) + 1, 1 << 20)
    kept = rows.where(~excluded(inside) & indexable(local))
    if scope is not None:
        kept = kept.where(scope_predicate(local, collapsed_paths(scope)))
    return kept.select(local.alias("path"), (F.unix_micros("modificationTime") * 1000).alias("modified_ns"), F.col("length").alias("bytes"), "content")


def decoded(content: Column) -> Column:
    """Strict UTF-8 text of at most 2 MiB; a cut-off last character is trimmed, NUL or other bytes give null."""
    part = F.substring(content, 1, MAX_TEXT)
    text = F.lit(None).cast("string")
    for back in range(4):
        t = F.substring(part, F.lit(1), F.octet_length(part) - back).cast("string")
        # only a truncated file may lose a tail
        text = F.coalesce(text, F.when(F.is_valid_utf8(t) & ((back == 0) | (F.octet_length(content) > MAX_TEXT)), t))
    return F.when(~F.contains(text, F.lit("\0")), text)


def documents(rows: DataFrame) -> DataFrame:
    """files() as documents: title, body prefix and extraction code (0 text, 2 none, 4 too large, 5 unreadable)."""
    text = decoded(F.col("content"))
    code = F.when(text.isNull(), 5).when(F.trim(text) == "", 2).otherwise(0)
    out = rows.withColumn("text", text).withColumn("extraction", code)
    name = F.element_at(F.split("path", "/"), -1)
    return out.select("path", name.alias("title"), cut_bytes(F.coalesce("text", F.lit("")), BODY).alias("body"), "text", "modified_ns", "bytes", "extraction", (F.col("bytes") > MAX_TEXT).alias("partial"))


_NS = {"a": "{http://schemas.openxmlformats.org/drawingml/2006/main}", "s": "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"}
_RELATIONS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
MAX_MEMBER, MAX_MEMBERS = 16 << 20, 10_000


class Unreadable(ValueError):
    """The archive is damaged, hostile or not an office file."""


def _tree(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    info = archive.getinfo(name)
    if info.file_size > MAX_MEMBER:
        raise Unreadable("a part is too large")
    data = archive.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise Unreadable("entities are not read")
    return ElementTree.fromstring(data)


def _ordered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def slides(archive: zipfile.ZipFile, most: int) -> str:
    """Text of the slides in number order, a form feed between."""
    pages = []
    for name in _ordered(archive.namelist(), r"ppt/slides/slide(\d+)\.xml")[:most]:
        paragraphs = ("".join(t.text or "" for t in p.iter(f"{_NS['a']}t")) for p in _tree(archive, name).iter(f"{_NS['a']}p"))
        pages.append("\n".join(p for p in paragraphs if p.strip()))
    return "\f".join(pages)


def sheets(archive: zipfile.ZipFile, most: int) -> str:
    """Each sheet under a heading, each row as 'Sheet n · Row r: A1: v | ...'; cached values only."""
    s = _NS["s"]
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{s}t")) for si in _tree(archive, "xl/sharedStrings.xml").iter(f"{s}si")]
    out = []
    for n, name in enumerate(_ordered(archive.namelist(), r"xl/worksheets/sheet(\d+)\.xml")[:most], 1):
        lines = [f"# Sheet {n}"]
        for row in _tree(archive, name).iter(f"{s}row"):
            cells = []
            for c in row.iter(f"{s}c"):
                if c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{s}t"))
                else:
                    v = c.find(f"{s}v")
                    value = "" if v is None else v.text or ""
                    if c.get("t") == "s" and value.isdigit():
                        value = shared[int(value)] if int(value) < len(shared) else ""
                if value.strip():
                    cells.append(f"{c.get('r', '?')}: {value}")
            if cells:
                lines.append(f"Sheet {n} · Row {row.get('r', '?')}: {' | '.join(cells)}")
        out.append("\n\n".join(lines))
    return "\f".join(out)


def paragraphs(archive: zipfile.ZipFile) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in _tree(archive, "word/document.xml").iter(f"{w}p"))
    return "\n\n".join(x for x in lines if x.strip())


def open_document(archive: zipfile.ZipFile) -> str:
    """Headings and paragraphs of an OpenDocument text."""
    t = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
    lines = ("".join(e.itertext()) for e in _tree(archive, "content.xml").iter() if e.tag in (f"{t}p", f"{t}h"))
    return "\n\n".join(x for x in lines if x.strip())


_RTF = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}\r\n]+)", re.S)
#: Groups that hold no text of the document.
_RTF_SKIPPED = set("fonttbl colortbl stylesheet info pict object header footer generator themedata listtable listoverridetable".split())
_RTF_MARKS = {"par": "\n\n", "line": "\n", "tab": "\t", "page": "\f", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rich_text(data: bytes) -> str:
    """Text of an RTF file; Unreadable if it is none or a group stays open."""
    if not data.startswith(b"{\\rtf"):
        raise Unreadable("not RTF")
    out, groups = [], []
    # of the open group: whether its text is skipped, and how many characters follow a Unicode one in its place
    skipped, spare, owed = False, 1, 0
    for word, number, byte, symbol, brace, plain in _RTF.findall(data.decode("latin-1")):
        if brace == "{":
            groups.append((skipped, spare))
        elif brace:
            if not groups:
                raise Unreadable("a group closes twice")
            skipped, spare = groups.pop()
            owed = 0
        elif symbol == "*" or word in _RTF_SKIPPED:
            skipped = True
        elif word == "uc":
            spare = int(number or 1)
        elif skipped:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            owed = spare
        elif byte or symbol in ("\\", "{", "}", "~"):
            if owed:
                owed -= 1
            else:
                out.append(bytes.fromhex(byte).decode("cp1252", "replace") if byte else symbol.replace("~", " "))
        elif word:
            out.append(_RTF_MARKS.get(word, ""))
        elif plain:
            out.append(plain[owed:])
            owed = max(0, owed - len(plain))
    if groups:
        raise Unreadable("a group stays open")
    # two halves of a character beyond the first plane
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def office_text(data: bytes, extension: str, most_sections: int = 400, most_bytes: int = MAX_TEXT) -> tuple[str, bool]:
    """(text, cut) of a pptx, xlsx, docx, odt or rtf file; Unreadable otherwise."""
    if extension == "rtf":
        return _within(rich_text(data), most_bytes)
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            if len(archive.namelist()) > MAX_MEMBERS or any(n.startswith("/") or ".." in n.split("/") for n in archive.namelist()):
                raise Unreadable("unsafe member names")
            read = {"pptx": lambda: slides(archive, most_sections), "xlsx": lambda: sheets(archive, most_sections), "docx": lambda: paragraphs(archive), "odt": lambda: open_document(archive)}.get(extension)
            if read is None:
                raise Unreadable(f"no reader for {extension}")
            text = read()
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, NotImplementedError, RuntimeError, EOFError) as e:
        raise Unreadable(str(e)) from e
    return _within(text, most_bytes)


def _within(text: str, most_bytes: int) -> tuple[str, bool]:
    raw = text.encode()
    return (text, False) if len(raw) <= most_bytes else (raw[:most_bytes].decode("utf-8", "ignore"), True)


def extracted(rows: DataFrame) -> DataFrame:
    """(path, text, extraction, partial) of office files rows(path, content); 1 text, 2 none, 5 unreadable."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    text, cut = office_text(bytes(content), path.rsplit(".", 1)[-1].lower())
                    out.append((path, text, 1 if text.strip() else 2, cut))
                except Unreadable:
                    out.append((path, "", 5, False))
            yield pd.DataFrame(out, columns=["path", "text", "extraction", "partial"])

    return rows.select("path", "content").mapInPandas(run, "path string, text string, extraction int, partial boolean")


def retry_set(docs: DataFrame, after: int = 0, most: int = 128) -> DataFrame:
    """The next failed or partial documents after an id."""
    return docs.where((F.col("document_id") > after) & ((F.col("extraction") >= 2) | F.col("partial"))).orderBy("document_id").limit(most)


def home_entries(paths: DataFrame, home: str, most: int = 4096) -> DataFrame:
    """Entries right below a home folder, no dotfiles."""
    rest = F.substring("path", len(home.rstrip("/")) + 2, 1 << 20)
    return paths.where(F.startswith("path", F.lit(home.rstrip("/") + "/")) & ~F.contains(rest, F.lit("/")) & ~F.startswith(rest, F.lit(".")) & (rest != "")).orderBy("path").limit(most)
