"""The operators' queries over the driver's tables, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, chat, decontaminate, jaccard, langid, licences, linededup, quality, resampling, store, tokencounts, topk, trie, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe_path() -> str:
    """The public tokenizer file; its package is installed wherever the workers run."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = tokencounts.Rollup(spark, store.new_path(spark, "op1-rollup"))
    batches = tokencounts.history(_table(spark, sf_dir, "documents"))
    for name, changes in batches.items():
        rollup.commit(name, changes)
    rollup.commit("second", batches["second"])  # a retry changes nothing
    return rollup.totals()


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_recurring_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version rejects, from the ledger of operator 4."""
    return quality.ablations(quality.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(_table(spark, sf_dir, "documents"), word_bpe_path(), ["doc_id"])
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    prototypes = langid.train(docs.where(~held))
    return langid.identify(docs.withColumn("held_out", held), prototypes, ["doc_id", "held_out"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)
    return rows.where("gap_reason is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.examples(table.unionByName(extra)))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licences.scan(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("licences", ",").alias("licences"), "status")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def rebuilt_conversations(table: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % 5, then c's own after its first h; h = crc32(c) % 9."""
    arrays = trie.turn_arrays(table)
    lead = arrays.select(F.col("conv_id").alias("lead_id"), F.slice("turns", 1, 8).alias("lead"))
    joined = arrays.join(lead, F.expr("conv_id - conv_id % 5") == F.col("lead_id"), "left").withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"))
    return joined.select("conv_id", F.expr("concat(coalesce(slice(lead, 1, h), cast(array() as array<binary>)), slice(turns, h + 1, size(turns)))").alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(rebuilt_conversations(_table(spark, sf_dir, "conversations")))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_parts(F.col("embedding"), 256).alias("v"))
    return topk.top_k(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), k=5)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = resampling.Features(most=1, buckets=10_000)
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), features, percent=10, min_words=20, seed=2024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_ngram_jaccard, op3_line_dedup, op4_quality_rules, op5_bpe, op6_language_id, op7_warc, op8_chat, op9_license_scan, op10_decontamination, op11_prefix_trie, op12_exact_topk, op13_importance_resampling, quality_ablations)
}
