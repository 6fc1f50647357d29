"""Inventory, status and shard aggregates of the document catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import extension_of

KINDS = (
    ("Notes & text", "txt md markdown rst"),
    ("PDF & Office documents", "pdf docx doc rtf odt pptx xlsx"),
    ("Code", "rs swift py js jsx ts tsx go java c h cpp hpp rb sh sql"),
    ("Data & config", "json toml yaml yml csv tsv xml"),
    ("Web pages & styles", "html css"),
)
SHARD = 65_536
DELTA = 2_048


def kind_label(path: Column) -> Column:
    out, ext = F.lit("Other"), extension_of(path)
    for label, extensions in KINDS:
        out = F.when(ext.isin(extensions.split()), label).otherwise(out)
    return out


def by_kind(docs: DataFrame) -> DataFrame:
    return docs.groupBy(kind_label(F.col("path")).alias("kind")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.desc("n"), "kind")


def by_folder(docs: DataFrame, most: int = 10) -> DataFrame:
    """Folders right below docs' ``root``; files that lie in the root itself count for the root."""
    rest = F.substring("path", F.length("root") + 2, F.lit(1 << 20))
    folder = F.when(F.contains(rest, F.lit("/")), F.concat("root", F.lit("/"), F.substring_index(rest, "/", 1))).otherwise(F.col("root"))
    return docs.where("root is not null").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).orderBy(F.desc("n"), "folder").limit(most)


def status(extraction: Column, partial: Column) -> Column:
    """Extraction code, 6 for a partial text."""
    return F.when(partial & (extraction < 2), 6).otherwise(extraction)


def attention(docs: DataFrame, most: int = 20) -> DataFrame:
    return docs.withColumn("status", status(F.col("extraction"), F.col("partial"))).where("status between 2 and 6").select("document_id", "path", "status").orderBy("document_id").limit(most)


def most_recent(docs: DataFrame, most: int = 8) -> DataFrame:
    return docs.select("path", "modified_ns").orderBy(F.desc("modified_ns"), "path").limit(most)


def totals(docs: DataFrame) -> DataFrame:
    """All counters of the index in one pass."""
    return docs.agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("extraction") == 1).alias("extracted"),
        F.count_if(F.col("partial")).alias("partial"),
        *[F.count_if(F.col("extraction") == k).alias(f"status_{k}") for k in (2, 3, 4, 5)],
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def vector_buckets(vectors: DataFrame, width: int = SHARD) -> DataFrame:
    """Key ranges (after, after + width] that hold vectors: count, first and last key."""
    bucket = F.floor((F.col("id") - 1) / width)
    return vectors.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("id").alias("first_key"), F.max("id").alias("through_key")).withColumn("after_key", F.col("bucket") * width)


def shard_state(vectors: DataFrame, through: int, built: int) -> DataFrame:
    """Rows inside and beyond a shard; it stays usable while a tenth at most is stale and few rows are newer."""
    inside = F.count_if(F.col("id") <= through)
    beyond = F.count_if(F.col("id") > through)
    out = vectors.agg(inside.alias("inside"), beyond.alias("beyond"), F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    stale = F.lit(built) - F.col("inside")
    return out.withColumn("reusable", (stale * 10 <= built) & (F.col("beyond") <= DELTA))


def shard_rows(vectors: DataFrame, shards: DataFrame, width: int = SHARD) -> DataFrame:
    """vectors(id) with their shard(after_key): a range join by equal buckets."""
    return vectors.withColumn("bucket", F.floor((F.col("id") - 1) / width)).join(shards.select((F.col("after_key") / width).cast("long").alias("bucket"), "after_key"), "bucket").drop("bucket")


def bounded_frequency(postings: DataFrame, most: int = 10_001) -> DataFrame:
    """Documents of each term, counted up to a bound."""
    return postings.groupBy("term").agg(F.least(F.count("*"), F.lit(most)).alias("df"))


def busy_folders(events: DataFrame, now: int, span: int = 300, least: int = 20, most: int = 3) -> DataFrame:
    """events(folder, at): folders with many changes in the trailing window."""
    live = events.where((F.col("at") > now - span) & (F.col("at") <= now))
    return live.groupBy("folder").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "folder").limit(most)


def mean_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector of each group: sums by (group, position), no vector list is held."""
    places = vectors.select(by, F.posexplode("embedding").alias("i", "x"))
    mean = places.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias("centroid"))


def explain_document(docs: DataFrame) -> DataFrame:
    """The first reason why a document is not found, in the order of diagnosis."""
    reason = (
        F.when(~F.col("in_scope"), "outside the indexed folders")
        .when(F.col("is_excluded"), "excluded by a rule")
        .when(~F.col("supported"), "not a supported kind")
        .when(F.col("extraction") == 3, "locked")
        .when(F.col("extraction") == 4, "too large")
        .when(F.col("extraction") == 5, "unreadable")
        .when(F.col("extraction") == 2, "no text")
        .when(F.col("n_passages") == 0, "not split yet")
        .when(F.col("n_vectors") < F.col("n_passages"), "meaning search incomplete")
        .otherwise("indexed")
    )
    return docs.withColumn("reason", reason)


def quality_metrics(ranks: DataFrame) -> DataFrame:
    """ranks(kind, rank or null, ms) to hit@1/5/10, MRR@10 and rounded-index latency quantiles by kind and overall."""
    both = ranks.unionByName(ranks.withColumn("kind", F.lit("all")))
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 9).alias(f"hit_{k}")
    mrr = F.round(F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)), 9).alias("mrr_10")
    n = F.row_number().over(Window.partitionBy("kind").orderBy("ms"))
    total = F.count("*").over(Window.partitionBy("kind"))
    placed = both.withColumn("n", n).withColumn("total", total)
    at = lambda q: F.max(F.when(F.col("n") == F.round((F.col("total") - 1) * q).cast("long") + 1, F.col("ms")))
    return placed.groupBy("kind").agg(F.count("*").alias("queries"), hit(1), hit(5), hit(10), mrr, at(0.5).alias("median_ms"), at(0.95).alias("p95_ms"))


def first_ranks(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank): best position from 1 of any expected path among hits(query_id, path, position)."""
    found = hits.join(expected.select("query_id", "path").distinct(), ["query_id", "path"]).groupBy("query_id").agg(F.min("position").alias("rank"))
    return expected.select("query_id").distinct().join(found, "query_id", "left")


def passes_gate(metrics: DataFrame) -> DataFrame:
    """metrics(lane, kind, hit_5): fused no worse overall and on words, better on meaning."""
    pick = lambda lane, kind: F.max(F.when((F.col("lane") == lane) & (F.col("kind") == kind), F.col("hit_5")))
    return metrics.agg(((pick("fused", "all") >= pick("lexical", "all")) & (pick("fused", "words") >= pick("lexical", "words")) & (pick("fused", "meaning") > pick("lexical", "meaning"))).alias("passes"))


def recall_at(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """Mean share of each query's exact first k that an approximate list has."""
    a = found.where(F.col("position") <= k).groupBy("query_id").agg(F.collect_set("id").alias("got"))
    b = exact.where(F.col("position") <= k).groupBy("query_id").agg(F.collect_set("id").alias("want"))
    return b.join(a, "query_id", "left").agg(F.avg(F.size(F.array_intersect("want", F.coalesce("got", F.array().cast("array<bigint>")))) / F.size("want")).alias("recall"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same bag of rows."""
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def merged_progress(parts: DataFrame) -> DataFrame:
    """Counters of parallel passes added, their flags or-ed: parts(indexed, skipped, failed, interrupted)."""
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("indexed", "skipped", "failed")], F.coalesce(F.bool_or("interrupted"), F.lit(False)).alias("interrupted"))


def clip_stats(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("clips"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def storage_bytes(manifest: DataFrame) -> DataFrame:
    """manifest(path, bytes) by top-level folder."""
    return manifest.groupBy(F.substring_index("path", "/", 2).alias("folder")).agg(F.sum("bytes").alias("bytes"))
