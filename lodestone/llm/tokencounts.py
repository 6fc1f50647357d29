"""Delta-maintained token counts by source, language and tokenizer version.

A batch of changes becomes signed rows: an insert adds a document and its tokens, a delete takes both
away, a revision adds the difference of its counts. Deltas are summed by group before anything is
shuffled or stored, so a hot source costs one row a task, and a store holds a few rows a batch.

A batch is committed when its folder has Spark's success mark. Committing a batch again does nothing;
an unfinished batch is overwritten. Totals are the sum over committed batches in any order; ``compact``
replaces them by one base that remembers their names.

Defined cases: null source or lang is a group of its own; null counts are 0; repeated rows count each
time they come; texts of any length are counted whole; an empty batch commits nothing but its name; of equal texts
the smallest doc_id stays, and all rows that share it; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import store

GROUP = ("source", "lang", "tokenizer")
TOTALS = ("n_docs", "n_tokens")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) sums of changes(op, source, lang, tokenizer, n_tokens, old_n_tokens).

    op is insert, delete or revise; old_n_tokens matters to revise alone. A column ``times`` (bigint), where there
    is one, says for how many equal changes a row stands.
    """
    new, old = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.coalesce(F.col("old_n_tokens").cast("long"), F.lit(0))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
    times = F.coalesce(F.col("times").cast("long"), F.lit(1)) if "times" in changes.columns else F.lit(1)
    rows = changes.select(*[F.col(c).cast("string").alias(c) for c in GROUP], (docs.cast("long") * times).alias("n_docs"), (tokens * times).alias("n_tokens"))
    return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in TOTALS])


class Rollup:
    """A store of committed deltas under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id) or batch_id.startswith((".", "_")):
            raise ValueError(f"not a batch name: {batch_id!r}")
        return f"{self.path}/batches/{batch_id}"

    def _bases(self) -> list[str]:
        return sorted(x for x in store.names(self.spark, f"{self.path}/bases") if store.exists(self.spark, f"{self.path}/bases/{x}/_SUCCESS"))

    def _absorbed(self) -> set[str]:
        bases = self._bases()
        if not bases:
            return set()
        return {r.batch for r in self.spark.read.schema("batch string").json(f"{self.path}/absorbed/{bases[-1]}").collect()}

    def committed(self, batch_id: str) -> bool:
        return store.exists(self.spark, f"{self._batch(batch_id)}/_SUCCESS") or batch_id in self._absorbed()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; whether this call did it."""
        if self.committed(batch_id):
            return False
        signed_deltas(changes).where("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(self._batch(batch_id))
        return True

    def _live(self) -> list[str]:
        gone = self._absorbed()
        return [x for x in sorted(store.names(self.spark, f"{self.path}/batches")) if x not in gone and store.exists(self.spark, f"{self._batch(x)}/_SUCCESS")]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of groups that still hold documents or tokens."""
        paths = [f"{self.path}/bases/{x}" for x in self._bases()[-1:]] + [self._batch(x) for x in self._live()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in TOTALS]).where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold committed batches into a new base; readers use the newest finished base."""
        live, absorbed, number = self._live(), self._absorbed(), len(self._bases())
        if not live:
            return
        name = f"base-{number:08d}"
        totals = self.totals()
        self.spark.createDataFrame([(x,) for x in sorted({*absorbed, *live})], "batch string").coalesce(1).write.mode("overwrite").json(f"{self.path}/absorbed/{name}")
        totals.write.mode("overwrite").parquet(f"{self.path}/bases/{name}")


#: Tokenizer versions that SQL can count, by pattern.
WORDS = r"[^\x20\x09-\x0D]+"
WORDS_WITH_TEXT = r"[^\x20\x09-\x0D]*[0-9A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*"
RUNS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def history(docs: DataFrame) -> dict[str, DataFrame]:
    """The batches of a corpus's life: counts by two tokenizer versions, a corrected count, removal of copies.

    load: all documents under words-1. second: the same under runs-2. correct: words-1 revised to words that
    hold a letter or digit. copies: of equal texts all but the smallest doc_id go, under both versions.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.unhex(F.sha2(t, 256)).alias("digest"), n(WORDS).alias("a"), n(WORDS_WITH_TEXT).alias("b"), n(RUNS).alias("c"))
    counts = store.written(counts, "op1-counts")
    # equal texts have equal counts, so copies are summed by group before they meet by text: a text in a third of all
    # documents is a row for each source and language there
    rows = counts.where("doc_id is not null").groupBy("digest", "source", "lang", "doc_id").agg(F.count("*").alias("rows"), F.any_value("b").alias("b"), F.any_value("c").alias("c"))
    groups = rows.groupBy("digest", "source", "lang").agg(F.sum("rows").alias("n"), F.min("doc_id").alias("first"), F.min_by("rows", "doc_id").alias("at_first"), F.any_value("b").alias("b"), F.any_value("c").alias("c"))
    least = groups.groupBy("digest").agg(F.min("first").alias("least"), F.sum("n").alias("all")).where("all > 1").select("digest", "least")
    copies = groups.join(least, "digest").withColumn("times", F.col("n") - F.when(F.col("first") == F.col("least"), F.col("at_first")).otherwise(0)).where("times > 0")
    one = lambda df: F.col("times") if "times" in df.columns else F.lit(1).cast("long")
    row = lambda df, op, tok, new, old=None: df.select(F.lit(op).alias("op"), "source", "lang", F.lit(tok).alias("tokenizer"), F.col(new).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_n_tokens"), one(df).alias("times"))
    return {
        "load": row(counts, "insert", "words-1", "a"),
        "second": row(counts, "insert", "runs-2", "c"),
        "correct": row(counts, "revise", "words-1", "b", "a"),
        "copies": row(copies, "delete", "words-1", "b").unionByName(row(copies, "delete", "runs-2", "c")),
    }
