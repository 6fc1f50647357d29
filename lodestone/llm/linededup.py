"""Line dedup through a fixed-depth log-template tree.

A line is a run of words between newlines. The tree's first level is the number of words, the next
``depth`` levels are the leading words, where a word with a digit counts as a variable field; only a line with fewer words without
a digit than with one is taken as it stands, and recurs only where all of it does. Inside a leaf, a word is constant at its position if more than half as many distinct lines of the leaf have it
there as have the line's other constant words; the rest generalise to variable fields, provided at least
``share`` of the line's words stay constant (else the line is its own template). Templates of a leaf that
are lines of one template by the same rule become one, until none changes. A template that comes in ``min_docs`` documents or more is
recurring: its lines stay in the first document (smallest doc_id) and are dropped from all others.

Lines of fewer than ``min_words`` words are left alone. Counting is by (leaf, position, word) sums, so no
leaf is ever held by one task, and the outcome does not depend on the order of the input.

Defined cases: null text stays null, an empty text stays empty; rows sharing a doc_id are one document;
rows with a null doc_id are kept as they are and do not count; blank and short lines are kept; lines and texts of
any length are taken whole; of documents with a line the smallest doc_id keeps it; an empty table gives no rows; columns
other than doc_id and text pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sketch import bloom_of
from lodestone.llm.store import written
from lodestone.llm.text import SPACED, U64, Words, buffers, mix, pieces, signed

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_FIELD = U64(0x5851F42D4C957F2D)
_AT = U64(0xC2B2AE3D27D4EB4F)
NEWLINE = 10


def place_keys(place: np.ndarray) -> np.ndarray:
    """What tells a word at one place of a line from the same word at another."""
    return mix(place.astype(U64) * _AT + U64(1))


_PLACES = place_keys(np.arange(4096))


class Lines:
    """Lines of a piece: hash with variable fields masked, leaf of the tree, count of words and of those without a digit."""

    def __init__(self, column: pa.Array, depth: int):
        raw, offsets = buffers(column)
        words = Words(raw, offsets, SPACED, np.arange(256, dtype=np.uint8))
        hashes = words.hashes()
        # words that hold a digit
        fields = np.zeros(len(hashes), bool)
        fields[np.searchsorted(words.starts, np.flatnonzero(_DIGIT[raw]), "right") - 1] = True
        # a line starts at a text's first byte and after each newline
        begins = np.zeros(len(raw) + 1, bool)
        begins[1:] = raw == NEWLINE
        begins[offsets[:-1]] = True
        starts = np.flatnonzero(begins[:-1])
        self.row = np.searchsorted(offsets, starts, "right") - 1
        self.first = np.searchsorted(words.starts, np.append(starts, len(raw)))
        self.count = np.diff(self.first)
        held = np.concatenate([[0], np.cumsum(~fields)])
        self.plain = held[self.first[1:]] - held[self.first[:-1]]
        # a line that is mostly numbers is data, and only equals itself
        fields &= np.repeat(2 * self.plain >= self.count, self.count)
        self.fields, self.tokens = fields, np.where(fields, _FIELD, hashes)
        heads = np.searchsorted(starts, offsets[:-1])
        self.number = np.arange(len(starts)) - heads[self.row]
        place = np.arange(len(self.tokens)) - np.repeat(self.first[:-1], self.count)
        spots = mix(self.tokens + (_PLACES[place] if place.max(initial=0) < len(_PLACES) else place_keys(place)))
        self.spots, self.place = spots, place
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(spots)])
        n = mix(self.count.astype(U64) + U64(7))
        self.hash = mix(sums[self.first[1:]] - sums[self.first[:-1]] + n)
        lead = np.minimum(self.first[:-1] + depth, self.first[1:])
        self.leaf = mix((sums[lead] - sums[self.first[:-1]]) ^ n)


def _index(depth: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lines = Lines(batch.column("text"), depth)
            at = np.flatnonzero(lines.count >= min_words)
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(lines.row[at])), pa.array(lines.number[at].astype(np.int32)), pa.array(signed(lines.leaf[at])), pa.array(signed(lines.hash[at]))],
                ["doc_id", "number", "leaf", "line"],
            )

    return run


def _spots(depth: int, min_words: int, share: float, wanted):
    """(leaf, line, words, spots) of the lines of leaves that hold several distinct lines; a spot is a word without a digit at its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = wanted.value
        for batch in pieces(batches, "text"):
            lines = Lines(batch.column("text"), depth)
            # digits are fields already: a line with too few other words can't be of a template
            at = np.flatnonzero((lines.count >= min_words) & (lines.plain >= share * lines.count - 1e-9) & bloom.has(lines.leaf))
            _, once = np.unique(lines.hash[at], return_index=True)
            at = at[once]
            sizes = lines.count[at]
            begin = np.repeat(lines.first[at], sizes)
            word = begin + np.arange(len(begin)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            word = word[~lines.fields[word]]
            cut = np.concatenate([[0], np.cumsum(lines.plain[at])])
            spots = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(signed(lines.spots[word])))
            yield pa.record_batch([pa.array(signed(lines.leaf[at])), pa.array(signed(lines.hash[at])), pa.array(sizes.astype(np.int32)), spots], ["leaf", "line", "words", "spots"])

    return run


def _fold(nodes: DataFrame, share: float) -> DataFrame:
    """(leaf, line, words, template, spots): what stays constant of each node (leaf, line, words, spots) that shares enough words.

    A line needs ``need`` constant words. The count of its ``need``-th most frequent word shows how large its
    family is; words that more than half of that many nodes of the leaf have are constant. The rarest words
    thus stay fields, however often their values recur in a large leaf.
    """
    spots = nodes.select("leaf", "line", "words", F.explode("spots").alias("spot"))
    common = spots.groupBy("leaf", "spot").agg(F.count("*").alias("lines")).where("lines > 1")
    seen = spots.join(common, ["leaf", "spot"]).groupBy("leaf", "line", "words").agg(F.sort_array(F.collect_list(F.struct("lines", "spot")), asc=False).alias("seen"))
    need = F.ceil(F.lit(share) * F.col("words") - F.lit(1e-9)).cast("int")
    family = F.get(F.col("seen.lines"), need - 1)
    constant = F.filter("seen", lambda x: 2 * x.lines > F.col("family"))
    out = seen.withColumn("family", family).where("family is not null").select("leaf", "line", "words", F.array_sort(F.transform(constant, lambda x: x.spot)).alias("spots"))
    return out.select("leaf", "line", "words", F.xxhash64("spots").alias("template"), "spots")


def templates(texts: DataFrame, index: DataFrame, depth: int, min_words: int, share: float, bloom_log2: int) -> DataFrame:
    """(leaf, line, template) of lines that generalise.

    Templates are folded again among themselves until none changes: each then counts once, so neither a
    frequent field value nor a larger template of the leaf hides that two templates are one.
    """
    distinct = index.groupBy("leaf").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("leaf")
    distinct = written(distinct, "op3-leaves")
    wanted = texts.sparkSession.sparkContext.broadcast(bloom_of(distinct, "leaf", bloom_log2))
    each = texts.mapInArrow(_spots(depth, min_words, share, wanted), "leaf long, line long, words int, spots array<long>")
    each = written(each.groupBy("leaf", "line").agg(F.any_value("words").alias("words"), F.any_value("spots").alias("spots")), "op3-spots")
    step = written(_fold(each, share), "op3-fold")
    lines, moves = step.select("leaf", "line", "template"), []
    while True:
        nodes = step.groupBy("leaf", "template").agg(F.any_value("words").alias("words"), F.any_value("spots").alias("spots"))
        step = written(_fold(nodes.withColumnRenamed("template", "line"), share), "op3-fold")
        moved = step.where("template <> line")
        if moved.isEmpty():
            break
        moves.append(moved.select("leaf", F.col("line").alias("template"), F.col("template").alias("wider")))
        # only leaves where a template lost a word can change again
        step = step.join(moved.select("leaf").distinct(), "leaf", "left_semi")
    # from the last round to the first: where each template ends
    ends = None
    for move in reversed(moves):
        if ends is None:
            ends = move
            continue
        later = ends.select("leaf", F.col("template").alias("wider"), F.col("wider").alias("end"))
        gone = move.join(later, ["leaf", "wider"], "left").select("leaf", "template", F.coalesce("end", "wider").alias("wider"))
        ends = written(gone.unionByName(ends.join(move, ["leaf", "template"], "left_anti")), "op3-ends")
    if ends is None:
        return lines
    return lines.join(ends, ["leaf", "template"], "left").select("leaf", "line", F.coalesce("wider", "template").alias("template"))


def recurring_lines(docs: DataFrame, depth: int = 3, min_words: int = 6, min_docs: int = 2, share: float = 0.7, bloom_log2: int = 23) -> DataFrame:
    """(doc_id, drop array<int>): numbers of the lines (from 0) that each document loses."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = written(texts.mapInArrow(_index(depth, min_words), "doc_id long, number int, leaf long, line long"), "op3-lines")
    named = written(templates(texts, index, depth, min_words, share, bloom_log2), "op3-templates")
    exact = index.groupBy("leaf", "line").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    families = exact.join(named, ["leaf", "line"], "left").withColumn("name", F.coalesce("template", F.xxhash64("line", F.lit("exact"))))
    if min_docs == 2:
        counted = families.groupBy("leaf", "name").agg(F.min("first").alias("owner"), F.max("last").alias("other")).where("owner <> other").select("leaf", "name", "owner")
    else:
        docs_of = index.select("leaf", "line", "doc_id").distinct().join(families.select("leaf", "line", "name"), ["leaf", "line"])
        counted = docs_of.groupBy("leaf", "name", "doc_id").agg(F.lit(1).alias("one")).groupBy("leaf", "name").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).where(F.col("n") >= min_docs).select("leaf", "name", "owner")
    decided = families.join(counted, ["leaf", "name"]).select("leaf", "line", "owner")
    hits = index.join(decided, ["leaf", "line"]).where("doc_id <> owner")
    return hits.groupBy("doc_id").agg(F.collect_set("number").alias("drop"))


def _cut(n_columns: int, text_at: int, with_counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(text_at).to_pylist(), batch.column(n_columns).to_pylist()
            out, n_lines, n_dropped = [], [], []
            for text, drop in zip(texts, drops):
                lines = [] if text is None else text.split("\n")
                gone = set(drop or ())
                out.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                n_lines.append(len(lines))
                n_dropped.append(len(gone))
            columns = [batch.column(i) for i in range(n_columns)]
            columns[text_at] = pa.array(out, pa.string())
            names = [f"c{i}" for i in range(n_columns)]
            if with_counts:
                columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                names += ["n_lines", "n_dropped"]
            yield pa.record_batch(columns, names)

    return run


def drop_recurring_lines(docs: DataFrame, counts: bool = False, **settings) -> DataFrame:
    """docs with recurring lines cut out of ``text``; all columns stay. With ``counts``, lines before and dropped follow."""
    drops = written(recurring_lines(docs, **settings), "op3-drops").withColumnsRenamed({"doc_id": "_drop_id", "drop": "_drop"})
    n, text_at = len(docs.columns), docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    key = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
    # the drops grow with the corpus, so this is never a broadcast join
    joined = plain.join(drops.hint("merge"), key == F.col("_drop_id"), "left").select(*plain.columns, "_drop")
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    schema = schema.replace(f"c{text_at} {docs.schema['text'].dataType.simpleString()}", f"c{text_at} string")
    out = joined.mapInArrow(_cut(n, text_at, counts), schema + (", n_lines long, n_dropped long" if counts else ""))
    return out.toDF(*docs.columns, *(["n_lines", "n_dropped"] if counts else []))
