"""Benchmark decontamination by winnowing.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` with A-Z lower-cased. A window is ``span``
consecutive words of an item (a shorter item is one window). Both sides keep the minimum k-gram hash of
each run of ``span - k + 1`` k-grams, so every shared window has a common fingerprint. Documents keep only
fingerprints that pass a fixed-size filter of the test side; the exact join follows; each candidate pair
is then extended window by window, where the words' bytes decide alone.

Items shorter than ``span`` are fingerprinted whole, and documents at the lengths that occur.

Defined cases: null, empty and word-less texts have no words, hits or items; texts of any length are taken
whole; repeated rows and null doc_ids give results of their own; a null item_id counts as an item named by the
empty string; empty tables give no rows or no hits; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sketch import bloom_of
from lodestone.llm.store import drop, written
from lodestone.llm.text import ALNUM, U64, Words, buffers, gram_hashes, mix, pieces, signed


def winnow(words: Words, hashes: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, row) of every k-gram that is a minimum of some run of span - k + 1 k-grams of its row."""
    grams, at = gram_hashes(words, hashes, k)
    row, width = words.row[at], span - k + 1
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    low = grams[:n].copy()
    for j in range(1, width):
        np.minimum(low, grams[j : j + n], out=low)
    whole = row[:n] == row[width - 1 :]
    chosen = np.zeros(len(grams), bool)
    for j in range(width):
        chosen[j : j + n] |= whole & (grams[j : j + n] == low)
    return mix(grams[chosen] ^ U64(span)), row[chosen]


def _exact(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    grams, at = gram_hashes(words, hashes, length)
    return mix(grams ^ U64(1 << 20) ^ U64(length)), words.row[at]


def _item_prints(span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(*buffers(batch.column("text")), ALNUM)
            hashes = words.hashes()
            found = [winnow(words, hashes, span, k)]
            for length in np.unique(words.counts[(words.counts > 0) & (words.counts < span)]):
                prints, row = _exact(words, hashes, int(length))
                mine = words.counts[row] == length
                found.append((prints[mine], row[mine]))
            prints, row = (np.concatenate(x) for x in zip(*found))
            yield pa.record_batch([batch.column("item_id").take(pa.array(row)), pa.array(words.counts[row].astype(np.int64)), pa.array(signed(prints))], ["item_id", "n_item", "print"])

    return run


def _candidates(span: int, k: int, lengths: list[int], test):
    """Every document with its word count; its folded text and passing fingerprints only where some pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = test.value
        for batch in pieces(batches, "text"):
            raw, offsets = buffers(batch.column("text"))
            words = Words(raw, offsets, ALNUM)
            hashes = words.hashes()
            found = [winnow(words, hashes, span, k), *(_exact(words, hashes, n) for n in lengths)]
            prints, row = (np.concatenate(x) for x in zip(*found))
            passing = bloom.has(prints)
            prints, row = prints[passing], row[passing]
            order = np.argsort(row, kind="stable")
            prints, row = signed(prints[order]), row[order]
            cut = np.searchsorted(row, np.arange(words.rows + 1))
            held = [np.unique(prints[cut[r] : cut[r + 1]]) if cut[r + 1] > cut[r] else None for r in range(words.rows)]
            data = [None if h is None else words.folded[offsets[r] : offsets[r + 1]].tobytes() for r, h in enumerate(held)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(held, pa.list_(pa.int64())), pa.array(data, pa.binary())], ["doc_id", "n_words", "prints", "folded"])

    return run


class Spelled:
    """One text's words: their hashes, and their bytes with one space between."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        words = Words(raw, np.array([0, len(raw)]), ALNUM)
        self.hashes = words.hashes()
        self.bytes = b" ".join(words.folded[s:e].tobytes() for s, e in zip(words.starts, words.ends))
        sizes = words.ends - words.starts
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes

    def __len__(self) -> int:
        return len(self.hashes)

    def window(self, at: int, width: int) -> bytes:
        return self.bytes[self.starts[at] : self.ends[at + width - 1]]


def occurrences(doc: Spelled, item: Spelled, span: int) -> np.ndarray:
    """First positions in doc of any window of item. Hashes point, the words' bytes decide."""
    width = min(span, len(item))
    if not width or len(doc) < width:
        return np.zeros(0, np.int64)

    def windows(x: np.ndarray) -> np.ndarray:
        n = len(x) - width + 1
        total = np.zeros(n, U64)
        for j in range(width):
            total += mix(x[j : j + n] + U64(j))
        return mix(total)

    ours, theirs = windows(doc.hashes), windows(item.hashes)
    hits = np.flatnonzero(np.isin(ours, theirs))
    if len(hits):
        spelled = {item.window(q, width) for q in range(len(theirs))}
        hits = hits[np.array([doc.window(p, width) in spelled for p in hits], bool)]
    return hits


def _extend(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, item_id, doc, item in zip(batch.column("key"), batch.column("item_id"), batch.column("folded"), batch.column("item")):
                doc, item = Spelled(doc.as_py()), Spelled((item.as_py() or "").encode())
                at = occurrences(doc, item, span)
                if len(at):
                    width = min(span, len(item))
                    gap = np.flatnonzero(np.diff(at) > width)
                    starts = at[np.concatenate([[0], gap + 1])]
                    stops = at[np.concatenate([gap, [len(at) - 1]])] + width
                    out.append((key.as_py(), item_id.as_py(), starts.tolist(), stops.tolist()))
            kinds = [pa.binary(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["key", "item_id", "starts", "stops"])

    return run


def _found(docs: DataFrame, benchmark: DataFrame, span: int, k: int, bloom_log2: int) -> tuple[DataFrame, DataFrame]:
    """(seen, found): documents with word count and key, and by key the runs and items of texts that hold some.

    The key is the SHA-256 of the folded text.
    """
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and span")
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    # an item_id that comes twice is one item with several texts
    items = items.withColumn("text_key", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["item_id", "text_key"])
    keyed = written(items.select(F.struct("item_id", "text_key").alias("k"), "text").select(F.to_json("k").alias("item_id"), "text"), "op10-items")
    prints = written(keyed.mapInArrow(_item_prints(span, k), "item_id string, n_item long, print long"), "op10-prints")
    lengths = sorted(r.n_item for r in prints.where(F.col("n_item") < span).select("n_item").distinct().collect())
    test = spark.sparkContext.broadcast(bloom_of(prints, "print", bloom_log2))
    seen = written(texts.mapInArrow(_candidates(span, k, lengths, test), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_words long, prints array<long>, folded binary"), "op10-seen")
    seen = seen.withColumn("key", F.when(F.col("folded").isNotNull(), F.unhex(F.sha2("folded", 256))))

    held = seen.where("key is not null")
    marks = held.select("key", F.explode("prints").alias("print")).distinct()
    pairs = marks.join(prints.select("print", "item_id").distinct(), "print").select("key", "item_id").distinct()
    doc_texts = held.select("key", "folded").dropDuplicates(["key"])
    spans = pairs.join(keyed.withColumnRenamed("text", "item"), "item_id").join(doc_texts, "key").select("key", "item_id", "folded", "item").mapInArrow(_extend(span), "key binary, item_id string, starts array<long>, stops array<long>")
    spans = spans.withColumn("item_id", F.from_json("item_id", "item_id string").item_id)

    # union of the runs of a document: a run adds what lies beyond all runs before it
    found = spans.groupBy("key").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "stops")))).alias("runs"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
    )
    found = written(found, "op10-found")
    drop(prints)
    drop(keyed)
    return seen, found


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, bloom_log2: int = 24) -> DataFrame:
    """Per row of docs(doc_id, text): n_words, n_hit, item_ids (sorted strings), hit spans (start, stop in words).

    ``bloom_log2`` fixes what is broadcast (2 MB at 24), whatever the size of the benchmark.
    """
    seen, found = _found(docs, benchmark, span, k, bloom_log2)
    joined = seen.select("doc_id", "n_words", "key").join(found, "key", "left")
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        F.coalesce("runs", F.array().cast("array<struct<starts:bigint,stops:bigint>>")),
        zero,
        lambda acc, run: F.struct(
            F.greatest(acc.reach, run.stops).alias("reach"),
            (acc.total + F.greatest(F.lit(0).cast("long"), run.stops - F.greatest(acc.reach, run.starts))).alias("total"),
        ),
        lambda acc: acc.total,
    )
    return joined.select("doc_id", "n_words", covered.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), F.col("runs").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, bloom_log2: int = 24) -> DataFrame:
    """docs without the rows whose text holds any window of the benchmark; columns unchanged.

    The text decides for each row, so null and repeated ids are handled like any other.
    """
    seen, found = _found(docs, benchmark, span, k, bloom_log2)
    dirty = found.select(F.col("key").alias("_dirty_key"))
    folded = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    names = [f"c{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*docs.columns, F.unhex(F.sha2(folded, 256)).alias("_text_key")).toDF(*names, "_text_key")
    return keyed.join(dirty, F.col("_text_key") == F.col("_dirty_key"), "left_anti").select(*names).toDF(*docs.columns)
