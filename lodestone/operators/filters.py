"""The typed filter language: parsed on the driver, compiled to Column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from fractions import Fraction
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import extension_of

DAY = 86_400
UNITS = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30}
TEXT_EXTENSIONS = "txt md markdown rst json toml yaml yml csv tsv xml html css rs swift py js jsx ts tsx go java c h cpp hpp rb sh sql".split()
DOCUMENT_EXTENSIONS = "pdf docx doc rtf odt pptx xlsx".split()
CODE_EXTENSIONS = "rs swift py js jsx ts tsx go java c h cpp hpp rb sh sql".split()
GROUPS = {
    "document": DOCUMENT_EXTENSIONS,
    "documents": DOCUMENT_EXTENSIONS,
    "docs": DOCUMENT_EXTENSIONS,
    "note": ["txt", "md", "markdown", "rst"],
    "notes": ["txt", "md", "markdown", "rst"],
    "text": ["txt", "md", "markdown", "rst"],
    "word": ["docx", "doc"],
    "code": CODE_EXTENSIONS,
}
MAX_ROOTS, MAX_EXCLUSIONS = 64, 128


class FilterError(ValueError):
    """The query is not in the filter language."""


@dataclass(frozen=True)
class Size:
    comparison: str
    bytes: int


@dataclass(frozen=True)
class Age:
    """today, yesterday, within or older (than ``days``)."""

    kind: str
    days: int = 0


@dataclass(frozen=True)
class FileQuery:
    name: str = ""
    kind: str | None = None
    size: Size | None = None
    modified: Age | None = None
    used: Age | None = None

    @property
    def filtered(self) -> bool:
        return any((self.kind, self.size, self.modified, self.used))


_WORD = re.compile(r'(?:[^\s"]|"(?:[^"\\]|\\.)*")+', re.S)
_QUOTED = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)


def words(text: str) -> list[tuple[str, bool]]:
    """(word, literal): a quote that begins a word makes it literal; \\ escapes inside quotes."""
    if _WORD.sub("", text).strip():
        raise FilterError("a quote is never closed")
    plain = lambda m: re.sub(r"\\(.)", r"\1", m[1], flags=re.S)
    found = [(_QUOTED.sub(plain, w), w.startswith('"')) for w in _WORD.findall(text)]
    return [x for x in found if x[0]]


def parse_size(value: str) -> Size:
    found = re.fullmatch(r"(>=|<=|>|<|=)?([0-9.]*)([^0-9.].*)?", value, re.S)
    sign, amount, unit = found.groups() if found else ("", "", "?")
    factor = UNITS.get((unit or "").upper())
    if factor is None:
        raise FilterError("size: wants a comparison, a number and a unit of bytes, as in size:>=20KB")
    if not re.fullmatch(r"[0-9]+(\.[0-9]{0,6})?", amount):
        raise FilterError("size: has a malformed number")
    exact = Fraction(amount.rstrip(".")) * factor
    if exact.denominator != 1:
        raise FilterError("size: gives a fraction of a byte")
    if exact > 2**63 - 1:
        raise FilterError("size: exceeds 64 bits")
    return Size(sign or "=", int(exact))


def parse_age(value: str) -> Age:
    named = {"today": Age("today"), "yesterday": Age("yesterday"), "week": Age("within", 7), "month": Age("within", 30)}
    if value in named:
        return named[value]
    found = re.fullmatch(r"(>?)\+?([0-9]+)d", value)
    if not found:
        raise FilterError("a date filter is a named span (today, yesterday, week, month) or a number of days (14d, >90d)")
    if not 1 <= int(found[2]) <= 36_500:
        raise FilterError("a date filter reaches 1 to 36500 days back")
    return Age("older" if found[1] else "within", int(found[2]))


def parse(text: str) -> FileQuery:
    """A typed query; an unknown key stays part of the name."""
    if len(text.encode()) > 4096 or "\0" in text:
        raise FilterError("a query has at most 4096 bytes and no NUL")
    names, got = [], {}
    for word, literal in words(text):
        key, colon, value = word.partition(":")
        if literal or not colon or key not in ("kind", "size", "modified", "used"):
            names.append(word)
            continue
        if key in got:
            raise FilterError(f"{key}: is given twice")
        if key == "kind":
            kind = "".join(c.lower() if c.isascii() else c for c in value)
            if not re.fullmatch(r"[a-z0-9]{1,16}", kind):
                raise FilterError("kind: is an extension or one of folder, image, audio, video")
            got[key] = kind
        else:
            got[key] = parse_size(value) if key == "size" else parse_age(value)
    return FileQuery(" ".join(names), **got)


def midnight(now: int, zone: str = "UTC") -> int:
    """Epoch seconds of the local day's start; days before it are of 86400 s each."""
    local = datetime.fromtimestamp(now, UTC).astimezone(ZoneInfo(zone))
    return int(local.replace(hour=0, minute=0, second=0, microsecond=0).timestamp())


def age_predicate(at: Column, age: Age, now: int, zone: str = "UTC") -> Column:
    """``at`` in epoch seconds against whole local days."""
    today = midnight(now, zone)
    return {
        "today": lambda: at >= today,
        "yesterday": lambda: (at >= today - DAY) & (at < today),
        "within": lambda: at >= today - age.days * DAY,
        "older": lambda: at < today - age.days * DAY,
    }[age.kind]()


def size_predicate(size: Column, wanted: Size) -> Column:
    return {">": size > wanted.bytes, ">=": size >= wanted.bytes, "<": size < wanted.bytes, "<=": size <= wanted.bytes, "=": size == wanted.bytes}[wanted.comparison]


def extension_predicate(path: Column, extensions: list[str]) -> Column:
    """One invalid extension matches nothing."""
    if any(not re.fullmatch(r"[a-z0-9]{1,16}", e) for e in extensions):
        return F.lit(False)
    return extension_of(path).isin(extensions)


def content_predicate(query: FileQuery, path: Column, size: Column, modified: Column, now: int, zone: str = "UTC") -> Column:
    """Predicate of a content search; filters that contents don't have are refused."""
    if query.used:
        raise FilterError("contents have no date of use")
    if query.kind in ("folder", "image", "audio", "video"):
        raise FilterError("files of this kind have no text")
    out = F.lit(True)
    if query.kind:
        out = out & extension_predicate(path, GROUPS.get(query.kind, [query.kind]))
    if query.size:
        out = out & size_predicate(size, query.size)
    if query.modified:
        out = out & age_predicate(modified, query.modified, now, zone)
    return out


def file_predicate(query: FileQuery, name: Column, path: Column, size: Column, modified: Column, used: Column, now: int, zone: str = "UTC") -> Column:
    out = F.contains(F.lower(name), F.lit(query.name.lower())) if query.name else F.lit(True)
    media = {"image": "png jpg jpeg gif heic tiff webp bmp svg", "audio": "mp3 m4a wav flac aac ogg", "video": "mp4 mov mkv avi webm"}
    if query.kind == "folder":
        out = out & path.endswith("/")
    elif query.kind:
        out = out & extension_predicate(path, media[query.kind].split() if query.kind in media else [query.kind])
    if query.size:
        out = out & size_predicate(size, query.size)
    for at, age in ((modified, query.modified), (used, query.used)):
        if age:
            out = out & age_predicate(at, age, now, zone)
    return out


def validated(path: str) -> str:
    if not path.startswith("/") or len(path.encode()) > 4096 or "\0" in path or ".." in path.split("/"):
        raise FilterError(f"not an absolute, plain path: {path!r}")
    return path.rstrip("/") or "/"


def under(path: Column, folder: str) -> Column:
    """The folder itself or anything below it, as a key range that storage statistics can prune."""
    base = validated(folder)
    if base == "/":
        return path.startswith("/")
    return (path == base) | ((path >= base + "/") & (path < base + "0"))


def scope_predicate(path: Column, roots: list[str], exclusions: list[str] = ()) -> Column:
    """Under any root and under no exclusion; no roots match nothing."""
    if len(roots) > MAX_ROOTS or len(exclusions) > MAX_EXCLUSIONS:
        raise FilterError(f"a scope takes {MAX_ROOTS} folders and {MAX_EXCLUSIONS} exclusions at most")
    inside, outside = F.lit(False), F.lit(False)
    for root in roots:
        inside = inside | under(path, root)
    for folder in exclusions:
        outside = outside | under(path, folder)
    return inside & ~outside


def collapsed_paths(paths: list[str]) -> list[str]:
    """Paths that lie under no other of them, sorted."""
    out: list[str] = []
    for p in sorted({validated(p) for p in paths}, key=lambda p: p.split("/")):
        if not out or not (p == out[-1] or p.startswith(out[-1].rstrip("/") + "/")):
            out.append(p)
    return sorted(out)


def without_descendants(paths: DataFrame, column: str = "path") -> DataFrame:
    """Rows whose path has no proper ancestor among the rows: an equi-join on ancestors, not a theta join."""
    parts = F.split(column, "/")
    ancestors = F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = paths.select(F.col(column).alias("_path"), F.explode(F.when(F.size(parts) > 2, ancestors)).alias("_up"))
    inner = up.join(paths.select(F.col(column).alias("_up")).distinct(), "_up", "left_semi").select("_path").distinct()
    return paths.join(inner, paths[column] == inner["_path"], "left_anti")


def longest_root(files: DataFrame, roots: list[str]) -> DataFrame:
    """files(path) with ``root``, the longest of the roots that contains it; null outside all."""
    path, best = F.col("path"), F.lit(None).cast("string")
    for root in sorted({validated(r) for r in roots}, key=len):
        best = F.when(path.startswith(root.rstrip("/") + "/"), F.lit(root)).otherwise(best)
    return files.withColumn("root", best)


SECRET = r"(?i)^(id_rsa|id_dsa|id_ecdsa|id_ed25519|credentials|secrets?)(\.|$)|\.(pem|key|p12|pfx|keychain|kdbx)$"
GENERATED = "node_modules DerivedData __pycache__ Pods target venv site-packages _deps vendor bower_components build dist".split()
BUNDLES = ".app .framework .bundle .plugin .appex .xpc".split()


def excluded(path: Column) -> Column:
    """Dotfiles, generated folders, likely secrets and the inside of bundles are not indexed."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.element_at(F.split(path, "/"), -1)
    return F.exists(parts, lambda p: p.startswith(".") | p.isin(GENERATED) | F.array_contains(F.transform(F.array(*map(F.lit, BUNDLES)), lambda b: F.endswith(p, b)), True)) | name.rlike(SECRET)


def indexable(path: Column, documents: bool = True) -> Column:
    return extension_of(path).isin(TEXT_EXTENSIONS + (DOCUMENT_EXTENSIONS if documents else []))


def semantic_eligible(path: Column, extraction: Column) -> Column:
    return (extraction == 1) | ((extraction == 0) & extension_of(path).isin("txt", "md", "markdown", "rst", "html"))


def passage_eligible(path: Column, extraction: Column) -> Column:
    data = extension_of(path).isin("json", "csv", "tsv", "xml", "yaml", "yml", "toml")
    return ((extraction == 1) & (extension_of(path) != "xlsx")) | ((extraction == 0) & ~data)


#: Documents whose text a reader takes out, whatever folder they are in (fixed values).
READ_KINDS = ("pdf", "docx", "doc", "rtf", "odt", "pptx")


def eligible_path(path: Column, code_roots: list[str]) -> Column:
    """Prose and read documents anywhere; anything else that is no data file only inside a code root. A null path is not eligible."""
    in_code = F.lit(False)
    for root in code_roots:
        in_code = in_code | under(path, root)
    code = F.coalesce(passage_eligible(path, F.lit(0)), F.lit(True))
    return F.coalesce(semantic_eligible(path, F.lit(0)), F.lit(False)) | F.coalesce(extension_of(path).isin(*READ_KINDS), F.lit(False)) | F.coalesce(code & in_code, F.lit(False))


#: Spoken phrases and the typed query they begin, longest first.
PHRASES = (
    ("find code mentioning ", ":content kind:code "),
    ("documents about ", ":content kind:documents "),
    ("notes about ", ":content kind:notes "),
    ("ask my notes ", ">docs "),
    ("ask my documents ", ">docs "),
)


def rewritten(text: str) -> str | None:
    """A phrase as a typed query; None if it is none or over 512 bytes."""
    plain = " ".join(text.split())
    if len(plain.encode()) > 512:
        return None
    for phrase, typed in PHRASES:
        if plain.lower().startswith(phrase) and len(plain) > len(phrase):
            return typed + plain[len(phrase) :]
    return None


def older_than(now: datetime, days: int) -> datetime:
    return now - timedelta(days=days)
