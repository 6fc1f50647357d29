"""A corpus pipeline of five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, jaccard, linededup, quality, store
from lodestone.llm.queries import word_bpe_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first that has them; n_chars follows the text."""
    out = linededup.drop_recurring_lines(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id; five words, similarity of 0.8 or more.

    Rows that share a doc_id are one document, and stay or go together; rows without one can't be named and stay.
    """
    groups = jaccard.near_duplicates(docs, k=5, num=80, den=100)
    gone = store.written(groups.where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "near-copies")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.join(gone, plain[docs.columns.index("doc_id")] == gone["gone"], "left_anti").toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with doc_id, lang and source."""
    return bpe.encoded(docs, word_bpe_path(), ["doc_id", "lang", "source"], decoded=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: Stages 2, 3 and 5 are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
