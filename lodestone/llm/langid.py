"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point alone. A trigram's vector binds
(multiplies) its letters' vectors, the first rotated twice, the second once. A text's profile bundles
(sums) the vectors of its trigrams; a language's prototype bundles the profiles of its labelled texts. The
prediction is the prototype of the largest cosine.

All sums are of whole numbers, so results do not depend on how rows are spread. What reaches the driver is
one vector per language.

Letters are lower-cased; every run of other characters counts as one space, also at both ends.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the language that
sorts first; with no labelled text at all every text is ``und``; negative cosines score 0; rows with a null
label or text teach nothing; texts of any length count whole; repeated rows teach and are answered each time; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import U64, mix, pieces

UNKNOWN = "und"
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower case where that is one letter."""
    if not _tables:
        n = sys.maxunicode + 1
        letters, lower = np.zeros(n, bool), np.arange(n)
        for code in range(n):
            c = chr(code)
            if c.isalpha():
                letters[code] = True
                if c.isupper() and len(small := c.lower()) == 1:
                    lower[code] = ord(small)
        _tables.extend((letters, lower))
    return _tables[0], _tables[1]


def letter_vector(code: int, width: int) -> np.ndarray:
    blocks = mix(np.arange(width // 64, dtype=U64) + mix(np.array([code], U64)) * U64(3))
    return np.unpackbits(blocks.view(np.uint8)).astype(np.int8) * 2 - 1


def _distinct_trigrams(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct trigram keys, which of them each position has)."""
    present = np.zeros(int(folded.max()) + 1, bool)
    present[folded] = True
    letters = np.flatnonzero(present)
    n = len(letters)
    if n**3 > 1 << 24:
        return np.unique((folded[:-2] << 42) | (folded[1:-1] << 21) | folded[2:], return_inverse=True)
    table = np.zeros(int(letters[-1]) + 1, np.int64)
    table[letters] = np.arange(n)
    small = table[folded]
    dense = (small[:-2] * n + small[1:-1]) * n + small[2:]
    seen = np.zeros(n**3, bool)
    seen[dense] = True
    used = np.flatnonzero(seen)
    order = np.zeros(n**3, np.int64)
    order[used] = np.arange(len(used))
    return (letters[used // (n * n)] << 42) | (letters[used // n % n] << 21) | letters[used % n], order[dense]


class Encoder:
    """Profiles of texts. Vectors of trigrams met before are kept, up to a bound on memory."""

    KEPT = 16384

    def __init__(self, width: int):
        if width % 64:
            raise ValueError("width must be a multiple of 64")
        self.width = width
        self.letters: dict[int, np.ndarray] = {}
        self.places: dict[int, int] = {}
        self.table = np.zeros((256, width), np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 4096:
                self.letters.clear()
            self.letters[code] = letter_vector(code, self.width)
        return self.letters[code]

    def _trigram(self, key: int) -> np.ndarray:
        a, b, c = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
        return np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        if len(self.places) + len(keys) > self.KEPT:
            self.places.clear()
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            at = self.places.get(key)
            if at is None:
                at = len(self.places)
                if at >= len(self.table):
                    grown = np.zeros((len(self.table) * 2, self.width), np.float32)
                    grown[: len(self.table)] = self.table
                    self.table = grown
                self.table[at] = self._trigram(key)
                self.places[key] = at
            out[i] = at
        return out

    def profiles(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """The bundle of each text's trigrams as whole numbers (float64, exact); None without a letter."""
        whole = "\n".join(t or "" for t in texts)
        codes = np.frombuffer(f"\n{whole}\n".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        breaks = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
        letters, lower = _letters()
        is_letter = letters[codes]
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        # each text gets a space in front, and one after its last letter
        keep[breaks] = True
        folded = np.where(is_letter, lower[codes], 32)[keep]
        first = np.cumsum(keep)[breaks] - 1
        if len(folded) < 3:
            yield from [None] * len(texts)
            return
        keys, inverse = _distinct_trigrams(folded)
        places = self._rows(keys) if len(keys) <= self.KEPT else None
        inside = np.zeros(len(folded) + 1, np.int64)
        np.cumsum(folded != 32, out=inside[1:])
        for r in range(len(texts)):
            # texts share the newline between them, which stands for a space of both
            begin, end = int(first[r]), int(first[r + 1])
            if inside[end] == inside[begin]:
                yield None
                continue
            while folded[end - 1] == 32 and end - 1 > begin:
                end -= 1
            if folded[begin] == 32 and folded[begin + 1] == 32:
                begin += 1
            local = inverse[begin : max(end - 1, begin)]
            counts = np.bincount(local, minlength=0)
            used = np.flatnonzero(counts)
            total = np.zeros(self.width)
            for i in range(0, len(used), 4096):
                at = used[i : i + 4096]
                rows, part = self._rows(keys[at]) if places is None else places[at], counts[at]
                # float32 is exact while a sum stays below 2**24
                kind = np.float32 if int(part.sum()) < 1 << 24 else np.float64
                total += part.astype(kind) @ self.table[rows].astype(kind, copy=False)
            yield total

    def profile(self, text: str | None) -> np.ndarray | None:
        return next(self.profiles([text]))


def _bundle(width: int):
    """Per task and language one summed profile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(width), {}
        for batch in pieces(batches, "text"):
            for lang, profile in zip(batch.column("lang").to_pylist(), encoder.profiles(batch.column("text").to_pylist())):
                if profile is not None:
                    if lang in sums:
                        sums[lang] += profile.astype(np.int64)
                    else:
                        sums[lang] = profile.astype(np.int64)
                if len(sums) >= 256:
                    yield _sums(sums)
                    sums = {}
        if sums:
            yield _sums(sums)

    return run


def _sums(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])


def train(labelled: DataFrame, width: int = 512) -> dict[str, np.ndarray]:
    """Prototype of each language in labelled(text, lang)."""
    rows = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    parts = rows.mapInArrow(_bundle(width), "lang string, v array<long>")
    place = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = place.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("v"))
    return {r.lang: np.array(r.v, dtype=np.float64) for r in whole.toLocalIterator()}


def _predict(width: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        encoder = Encoder(width)
        for batch in pieces(batches, "text"):
            langs, scores = [], []
            for profile in encoder.profiles(batch.column("text").to_pylist()):
                if profile is None or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                norm = float(np.sqrt(profile @ profile))
                cosines = matrix @ profile / norm if norm else np.zeros(len(names))
                best = int(np.argmax(np.round(cosines, 12)))
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], width: int = 512) -> DataFrame:
    """(keep..., lang_pred, score) of docs(text, ...)."""
    names = sorted(prototypes)
    rows = [prototypes[n] / max(float(np.linalg.norm(prototypes[n])), 1.0) for n in names]
    held = docs.sparkSession.sparkContext.broadcast((names, np.array(rows).reshape(len(names), width)))
    plain = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in keep)
    return plain.mapInArrow(_predict(width, held), schema + ", lang_pred string, score double")
