"""N-gram Jaccard join with several global token orders.

A text's set is its distinct k-word shingles (lower-cased A-Z). Two sets with Jaccard similarity of at
least t share a token in their prefixes under *every* global token order, a prefix being the first
``n - ceil(t n) + 1`` tokens. Candidates come from an equi-join on the first order; a pair survives only
if its prefixes also meet under the second and third orders; survivors are verified on whole sets.

All three orders put frequent tokens last: first by a fixed-size count sketch of shingles, which shows
boilerplate, then by the expected frequency of the shingle's words, from a sketch of word counts. They
differ in the permutation inside a frequency class. Any order gives exact results.

A token at place p of a set of n says more than that it is shared: if it is the first that two sets share,
none of the p before it is common, so the partner can have at most ``(n - p) (1 + t) / t - n`` tokens. Both
sides must allow the other's size. A pair that links passes in the bucket of its first common token.

Dense groups never give all pairs. Equal sets collapse to one representative first. Each token bucket
proposes pairs with one pivot, the set in which the token comes earliest: it holds the fewest tokens of its
own, so it lies in the middle of its group. Links found are contracted to components; afterwards only
buckets that still hold several components are looked at. While their pairs would outnumber their rows by
far and a further pivot still ties components together, another round with other pivots follows; the pairs of
different components that are left are then compared, each where a run of common tokens starts. What is left
out could only link documents already connected. Histograms of the sets bound from above what two texts can share
and dismiss most pairs that don't link, so few sets move.

Shingles are told apart by 64-bit hashes of 64-bit word hashes. Sets are made again from the texts, for
documents of candidate pairs only: they are the bulk of what could be stored or moved.

Defined cases: null, empty and word-less texts have no shingles and link with nothing; a text of fewer
than k words is one shingle; a text of any length is taken whole; equal rows have equal sets; rows sharing a
doc_id are one document, linked through any of their texts; an empty text under such an id stays alone; a
null doc_id comes back with a null component and links nothing; an empty table gives no rows; other columns
are ignored, whatever their names; of a class the smallest doc_id names it, so ties don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.graph import components
from lodestone.llm.sketch import bloom_of, emit, merged
from lodestone.llm.store import drop, written
from lodestone.llm.text import U64, Words, buffers, gram_hashes, mix, pieces, signed

#: Rounds of pivots beyond the first, and how many pairs a row of the open buckets may stand for before one is worth it.
ROUNDS, PAIRS_A_ROW = 4, 8
#: Places of a token beyond this one rank alike when pivots are chosen.
LAST_PLACE = 4095
_ORDERS = (U64(0), U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25))


def shingle_sets(column: pa.Array, k: int, word_bits: np.ndarray | None = None, shift: np.uint64 = U64(44)) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(row, sorted distinct shingle hashes, summed word bits of each) for each row of a string column."""
    raw, offsets = buffers(column)
    words = Words(raw, offsets)
    hashes = words.hashes()
    grams, at = gram_hashes(words, hashes, k)
    commonness = None
    if word_bits is not None:
        sums = np.concatenate([[0], np.cumsum(word_bits[(hashes >> shift).astype(np.int64)], dtype=np.int64)])
        commonness = sums[at + k] - sums[at]
    ends = np.cumsum(np.maximum(words.counts - k + 1, 0))
    for r in range(words.rows):
        n = int(words.counts[r])
        if n >= k:
            mine = slice(ends[r] - (n - k + 1), ends[r])
            if commonness is None:
                yield r, np.unique(grams[mine]), None
            else:
                s, first = np.unique(grams[mine], return_index=True)
                yield r, s, commonness[mine][first]
        elif n:
            h = hashes[words.first[r] : words.first[r + 1]]
            whole = mix(np.array([n], U64) + U64(1 << 32))
            for x in h:
                whole = mix(whole + x)
            yield r, whole, np.zeros(1, np.int64)
        else:
            yield r, np.zeros(0, U64), np.zeros(0, np.int64)


def word_counts(column: pa.Array, counts: np.ndarray, shift: np.uint64) -> None:
    """Add the words of a string column to a count sketch."""
    cells, times = np.unique((Words(*buffers(column)).hashes() >> shift).astype(np.int64), return_counts=True)
    counts[cells] += times.astype(counts.dtype)


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(0)


def _binary(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _longs(lists: list[np.ndarray]) -> pa.Array:
    sizes = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=sizes[1:])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(signed(np.concatenate([np.zeros(0, U64), *lists])), pa.int64()))


def _describe(k: int, sketch_log2: int):
    """Per document (id, n, signature) rows and, at the task's end, the slices of its count sketch."""
    names = ["doc_id", "n", "sig", "slice", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = np.zeros(1 << sketch_log2, np.uint32), np.zeros(1 << sketch_log2, np.uint32)
        for batch in pieces(batches, "text"):
            n, sig, all_sets = [], [], []
            word_counts(batch.column("text"), words, U64(64 - sketch_log2))
            for _, s, _ in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                all_sets.append(s)
            cells = (np.concatenate(all_sets) >> U64(64 - sketch_log2)).astype(np.int64)
            at, times = np.unique(cells, return_counts=True)
            counts[at] += times.astype(np.uint32)
            blank = [None] * len(n)
            yield pa.record_batch([_ids(batch), pa.array(n, pa.int64()), _binary(sig), pa.array(blank, pa.int32()), _binary(blank)], names)
        for i, data in emit(np.concatenate([counts, words])):
            yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), _binary([None]), pa.array([i], pa.int32()), _binary([data])], names)

    return run


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 for cells near the sketch's mean load, else the logarithm of the count."""
    floor = 2 * counts.mean() + 8
    return np.where(counts <= floor, 0, np.log2(np.maximum(counts, 1)).astype(np.int64)).astype(np.uint8)


def word_classes(counts: np.ndarray) -> np.ndarray:
    """Four times the logarithm of the count."""
    return (4 * np.log2(counts + 1.0)).astype(np.uint8)


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefix(tokens: np.ndarray, common: np.ndarray, classes: np.ndarray, shift: np.uint64, order: np.uint64, size: int) -> np.ndarray:
    boilerplate = classes[(tokens >> shift).astype(np.int64)].astype(U64)
    # steps of two bits of expected frequency, at most 255 of them
    cls = (boilerplate << U64(8)) | np.minimum(common // 8, 255).astype(U64)
    key = (cls << U64(50)) | (mix(tokens ^ order) >> U64(14))
    return tokens[np.argsort(key, kind="stable")[:size]]


def _prefixes(k: int, num: int, den: int, classes, sketch_log2: int):
    """(doc_id, n, pre): sizes and first-order prefixes of all texts with words."""
    shift = U64(64 - sketch_log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, word_bits = classes.value
        for batch in pieces(batches, "text"):
            keep, sizes, held = [], [], []
            for r, s, common in shingle_sets(batch.column("text"), k, word_bits, shift):
                if len(s):
                    keep.append(r)
                    sizes.append(len(s))
                    held.append(_prefix(s, common, table, shift, _ORDERS[0], prefix_size(len(s), num, den)))
            yield pa.record_batch([_ids(batch).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), _longs(held)], ["doc_id", "n", "pre"])

    return run


def _of_wanted(k: int, classes, sketch_log2: int, wanted, packed):
    """(doc_id, n, data) of the wanted documents: a set's size and what ``packed`` makes of the set and its words' commonness."""
    shift = U64(64 - sketch_log2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, word_bits = classes.value
        for batch in pieces(batches, "text"):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(wanted.value.has(np.ascontiguousarray(ids, dtype=np.int64))))
            if not batch.num_rows:
                continue
            keep, sizes, data = [], [], []
            for r, s, common in shingle_sets(batch.column("text"), k, word_bits, shift):
                if len(s):
                    keep.append(r)
                    sizes.append(len(s))
                    data.append(packed(s, common, table, shift))
            yield pa.record_batch([_ids(batch).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), _binary(data)], ["doc_id", "n", "data"])

    return run


def _as_histogram(s: np.ndarray, common: np.ndarray, table: np.ndarray, shift: np.uint64) -> bytes:
    return cell_bytes(histogram(s))


def _as_set(num: int, den: int):
    """The set's size, its prefixes in the second and third orders, the set."""

    def packed(s: np.ndarray, common: np.ndarray, table: np.ndarray, shift: np.uint64) -> bytes:
        pre = [_prefix(s, common, table, shift, order, prefix_size(len(s), num, den)) for order in _ORDERS[1:]]
        return b"".join(x.tobytes() for x in (np.array([len(s)], U64), *pre, s))

    return packed


def histogram(tokens: np.ndarray) -> np.ndarray:
    """Counts of a set's tokens by their low bits; about four tokens a cell, 128 to 4096 cells.

    Shared tokens fall into the same cells on both sides, so the sum of cell-wise minima exceeds the
    intersection only by chance meetings of tokens that are not shared: a close upper bound, never below.
    """
    cells = 1 << min(12, max(7, int(len(tokens) // 4).bit_length()))
    return np.bincount((tokens & U64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint32)


def cell_bytes(cells: np.ndarray) -> bytes:
    """A histogram in bytes. A cell beyond 255 would make the bound too low, so such a text gets one that says nothing."""
    return cells.astype(np.uint8).tobytes() if cells.max(initial=0) < 256 else b""


def most_common(x: np.ndarray, y: np.ndarray) -> int:
    """Upper bound of the intersection of two sets from their histograms; the larger one is folded."""
    cells = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, cells).sum(0), y.reshape(-1, cells).sum(0)).sum())


def _bounded(num: int, den: int):
    """Of pairs (a, b, n_a, n_b, hist_a, hist_b) those whose histograms allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                x, y = np.frombuffer(x.as_buffer(), np.uint8).astype(np.uint32), np.frombuffer(y.as_buffer(), np.uint8).astype(np.uint32)
                common = most_common(x, y) if len(x) and len(y) else int(min(n_a[i], n_b[i]))
                keep[i] = den * common >= num * (n_a[i] + n_b[i] - common)
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _opened(data) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(second prefix, third prefix, set) of what ``_as_set`` packed behind the set's size."""
    x = np.frombuffer(data.as_buffer(), U64)
    n, p = int(x[0]), (len(x) - 1 - int(x[0])) // 2
    return x[1 : p + 1], x[p + 1 : 2 * p + 1], x[len(x) - n :]


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two arrays without repeats."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _verify(num: int, den: int):
    """Of pairs (a, b, n_a, n_b, data_a, data_b) those whose prefixes meet in the second and third orders and whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5))):
                (x2, x3, x), (y2, y3, y) = _opened(x), _opened(y)
                if _common(x2, y2) and _common(x3, y3):
                    common = _common(x, y)
                    keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def _with_both(pairs: DataFrame, named: DataFrame, whole, packed, bloom_log2: int) -> tuple[DataFrame, DataFrame]:
    """(pairs(a, b, n_a, n_b, data_a, data_b), table to drop): made from the texts of the pairs' documents alone."""
    k, _, _, classes, sketch_log2 = whole
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = named.sparkSession.sparkContext.broadcast(bloom_of(ends, "doc_id", bloom_log2))
    rows = named.mapInArrow(_of_wanted(k, classes, sketch_log2, wanted, packed), "doc_id long, n long, data binary")
    rows = written(rows.join(ends.distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "data"]), "op2-wanted")
    wanted.unpersist()
    both = pairs
    for side in "ab":
        both = both.join(rows.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("data").alias(f"data_{side}")), side)
    return both.select("a", "b", "n_a", "n_b", "data_a", "data_b"), rows


def _links(pairs: DataFrame, named: DataFrame, whole, bloom_log2: int) -> DataFrame:
    """Links (a, b) among distinct candidate pairs (a, b): histograms first, then the other orders and whole sets."""
    _, num, den, _, _ = whole
    pairs = written(pairs, "op2-pairs")
    both, rows = _with_both(pairs, named, whole, _as_histogram, bloom_log2)
    near = written(both.mapInArrow(_bounded(num, den), "a long, b long").distinct(), "op2-bounded")
    drop(pairs)
    drop(rows)
    both, rows = _with_both(near, named, whole, _as_set(num, den), bloom_log2)
    out = written(both.mapInArrow(_verify(num, den), "a long, b long"), "op2-links")
    drop(near)
    drop(rows)
    return out


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """rows with their ``rank`` in the bucket and the bucket's ``first``: its pivot is the row of that rank.

    The first round takes the set in which the token comes earliest, later rounds any.
    """
    place = F.least("p", F.lit(LAST_PLACE)) if seed == 0 else F.lit(0)
    ranked = rows.withColumn("rank", place.cast("long") * F.lit(1 << 51) + F.shiftrightunsigned(F.xxhash64("rep", F.lit(seed)), 13))
    return ranked.join(ranked.groupBy("token").agg(F.min("rank").alias("first")), "token")


def _pivot_pairs(ranked: DataFrame) -> DataFrame:
    """Distinct pairs of each bucket's pivot with its members in other components."""
    pivots = ranked.where("rank = first").select("token", *[F.col(c).alias(f"v_{c}") for c in ("rep", "n", "hi", "comp")])
    near = ranked.join(pivots, "token").where("rep <> v_rep and comp <> v_comp and n <= v_hi and v_n <= hi")
    return near.select(F.least("rep", "v_rep").alias("a"), F.greatest("rep", "v_rep").alias("b")).distinct()


def _placed(ranked: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (token, rep, n, hi, p, comp) that may still link: in buckets of several components, where sizes allow it.

    A pivot has been compared with its whole bucket and leaves it.
    """
    label = components(links).withColumnRenamed("id", "rep")
    placed = ranked.where("rank <> first").drop("comp", "rank", "first").join(label, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    bucket = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("last"), F.min("n").alias("least_n"), F.max("hi").alias("most")).where("lo <> last").drop("lo", "last")
    return placed.join(bucket, "token").where("hi >= least_n and n <= most").drop("least_n", "most")


def _left_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of a bucket in different components: the smaller set's place must allow an equal or larger one.

    Two sets that also meet in the bucket of the token before, on both sides, were paired there.
    """
    rows = rows.withColumn("before", F.lag("token").over(Window.partitionBy("rep", "n").orderBy("p", "token")))
    small = rows.where("hi >= n").select("token", *[F.col(c).alias(f"s_{c}") for c in ("rep", "n", "hi", "comp", "before")])
    order = "(s_n < n or (s_n = n and s_rep < rep)) and s_comp <> comp and n <= s_hi and s_n <= hi and not coalesce(s_before = before, false)"
    return small.join(rows, "token").where(order).select(F.least("rep", "s_rep").alias("a"), F.greatest("rep", "s_rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, sketch_log2: int = 20, bloom_log2: int = 23) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of docs(doc_id, text, ...); linked at Jaccard num/den.

    ``sketch_log2`` and ``bloom_log2`` fix the size of what is broadcast (2 bytes a cell, 1 bit a slot).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(texts.mapInArrow(_describe(k, sketch_log2), "doc_id long, n long, sig binary, slice int, data binary"), "op2-sets")
    per_doc = first.where("slice is null").select("doc_id", "n", "sig")
    cells = first.where("slice is not null").select("slice", "data")
    shingles, words = np.split(merged(cells, "uint32", 2 << sketch_log2, "add"), 2)
    classes = spark.sparkContext.broadcast((frequency_classes(shingles), word_classes(words)))

    alike = per_doc.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    reps = alike.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    named = texts.where("doc_id is not null")
    pre = named.mapInArrow(_prefixes(k, num, den, classes, sketch_log2), "doc_id long, n long, pre array<long>")
    pre = written(pre.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id", "n", "pre"]), "op2-prefixes")
    # the size and the place travel as one number
    rows = pre.select(F.col("doc_id").alias("rep"), "n", F.posexplode("pre").alias("p", "token")).select("token", "rep", (F.shiftleft("n", 24) + F.col("p")).alias("at"))
    busy = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    held = rows.join(busy, "token", "left_semi").withColumn("n", F.shiftright("at", 24)).withColumn("p", F.col("at").bitwiseAND((1 << 24) - 1))
    rows = written(held.select("token", "rep", "n", F.expr(f"(n - p) * {den + num} div {num} - n").alias("hi"), "p", F.col("rep").alias("comp")), "op2-busy")
    drop(pre)

    whole = (k, num, den, classes, sketch_log2)
    links = None
    for turn in range(ROUNDS + 1):
        ranked = written(_ranked(rows, turn), "op2-ranked")
        drop(rows)
        more = _links(_pivot_pairs(ranked), named, whole, bloom_log2)
        links = more if links is None else links.unionByName(more)
        rows = written(_placed(ranked, links), "op2-open")
        drop(ranked)
        sizes = rows.groupBy("token").agg(F.count("*").alias("c"), F.count_if(F.expr("hi >= n")).alias("s")).agg(F.sum("c").alias("rows"), F.sum(F.expr("c * s")).alias("pairs")).first()
        # where the last pivots tied little together, the rest are groups of their own
        if not sizes.rows or sizes.pairs <= PAIRS_A_ROW * sizes.rows or (turn and 100 * more.count() < sizes.rows):
            break
    links = links.unionByName(_links(_left_pairs(rows), named, whole, bloom_log2))
    drop(rows)
    # rows that share an id but not a text tie their classes together
    torn = per_doc.where("sig is not null").groupBy("doc_id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("doc_id")
    ties = per_doc.join(torn, "doc_id", "left_semi").join(alike, "sig").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = components(links.unionByName(ties))

    classed = alike.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("class"))
    out = per_doc.join(classed, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))
