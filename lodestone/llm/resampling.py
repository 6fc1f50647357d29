"""Target-distribution importance resampling: hashed n-gram gains, and a Gumbel draw of the best documents.

Scoring explodes nothing: higher-order functions make a document's bucket array, and one aggregate adds the
gains of its buckets out of a literal array. Only bucket totals and, for the draw, thin score rows are shuffled.

Cases: null and empty texts have no features and weight 0; texts of any length are read whole; an empty table
has totals of 0, so every gain is that of unseen buckets; repeated rows each count and can each be drawn; rows
without an id draw their luck from the empty string and come last in ties; other columns, whatever their names,
are ignored by the draw and kept by ``weighed`` (which raises where one is called like a column it adds).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters a-z and all characters beyond ASCII, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``most`` consecutive words, hashed into ``buckets``."""

    most: int = 1
    buckets: int = 10_000

    def of(self, tokens: Column) -> Column:
        """The bucket of each feature of an array of words, repeats kept."""

        def bucket(f: Column) -> Column:
            return (F.crc32(f) % self.buckets).cast("int")

        def runs(w: Column, n: int) -> Column:
            if n == 1:
                return F.transform(w, bucket)
            starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: bucket(F.array_join(F.slice(w, i, n), " ")))

        if self.most == 1:
            return runs(tokens, 1)
        # as the variable of a lambda the words are found once, not once a run
        return F.element_at(F.transform(F.array(tokens), lambda w: F.concat(*[runs(w, n) for n in range(1, self.most + 1)])), 1)

    def totals(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(bucket, n) over all texts; tasks add up their own buckets first, so at most ``buckets`` rows a task are shuffled."""
        return docs.select(F.explode(self.of(words(docs[text]))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))

    def gains(self, raw: DataFrame, target: DataFrame) -> list[int]:
        """floor(1000 ln) of the smoothed target share over the raw share of each bucket; the driver gets ``buckets`` numbers."""
        every = raw.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))
        s, t = raw.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
        held = every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
        sums = held.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
        ratio = (F.col("t") + 1) * (F.col("all_s") + float(self.buckets)) / ((F.col("s") + 1) * (F.col("all_t") + float(self.buckets)))
        # one row of sums beside a fixed number of buckets
        rows = held.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))
        return [r.gain for r in rows.orderBy("bucket").collect()]


def weighed(docs: DataFrame, features: Features, gains: list[int], text: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight, the sum of the gains of its features."""
    taken = {"n_words", "n_features", "weight"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"documents already have columns {sorted(taken)}")
    # one constant: the optimizer folds the cast of the split text into an array literal
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")
    tokens, buckets = words(docs[text]), features.of(F.col("_words"))
    kept = docs.columns
    out = docs.withColumn("_words", tokens).withColumn("_buckets", buckets)
    total = F.aggregate("_buckets", F.lit(0).cast("bigint"), lambda acc, b: acc + F.element_at(table, b + 1))
    return out.select(*[out[f"`{c}`"] for c in kept], F.size("_words").cast("long").alias("n_words"), F.size("_buckets").cast("long").alias("n_features"), total.alias("weight"))


def luck(key: Column, seed: int) -> Column:
    """floor(1000 x a standard Gumbel variable), from the first 32 bits of sha256('seed:key')."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def drawn(rows: DataFrame, key: str, percent: int, min_words: int, seed: int) -> DataFrame:
    """rows(key, n_words, n_features, weight) as (key, n_features, weight, score, rank): of the N rows with
    ``min_words`` words the floor(percent * N / 100) highest scores get ranks 1, 2, 3 ...; ties go to the smaller key.

    A range sort deals the rows out by score, so a task numbers its own and one count a task is all that is gathered.
    The scores are written first, as the sort reads its input twice, once for its bounds.
    """
    scored = rows.select(key, "n_features", "weight", (F.col("weight") + luck(F.col(key), seed)).alias("score"), (F.col("n_words") >= min_words).alias("enough"))
    scored = store.written(scored, "scored")
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last(key), F.asc("n_features"), F.asc("weight")]
    place = F.monotonically_increasing_id()  # the task's number above 33 bits of the row's place in it
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_task", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND((1 << 33) - 1))
    held = store.written(dealt, "drawn")
    store.drop(scored)
    sizes = sorted((r._task, r.n) for r in held.where("enough").groupBy("_task").agg(F.count("*").alias("n")).collect())
    begin, before = {}, 0
    for task, n in sizes:
        begin[task] = before
        before += n
    most = percent * before // 100
    starts = held.sparkSession.createDataFrame(list(begin.items()), "_task long, _before long")
    # as many rows as the sort had tasks
    ranked = held.join(F.broadcast(starts), "_task", "left").withColumn("rank", F.col("_before") + F.col("_at") + 1)
    return ranked.select(key, "n_features", "weight", "score", F.when(F.col("enough") & (F.col("rank") <= most), F.col("rank")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, features: Features, percent: int, min_words: int, seed: int, key: str = "doc_id") -> DataFrame:
    """Every document's key, n_features, weight, score and rank (null where undrawn) towards the texts of ``target``."""
    gains = features.gains(features.totals(docs), features.totals(target))
    return drawn(weighed(docs.select(key, "text"), features, gains), key, percent, min_words, seed)
