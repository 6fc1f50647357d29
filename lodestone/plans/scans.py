"""Plans over files that Spark writes from the tables and a folder walk finds again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.plans.registry import query, table
from lodestone.sources import walk

ROWS_PER_FILE = 512


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The documents as JSON files in folders of their source and language, beside a folder that no scan may enter."""
    at = scratch.fresh(spark, "tree")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    docs.write.partitionBy("source", "lang").option("maxRecordsPerFile", ROWS_PER_FILE).json(f"{at}/docs")
    table(spark, sf_dir, "labels").write.json(f"{at}/node_modules")
    return walk.local_path(at)


def _read(listing: DataFrame) -> DataFrame:
    """(doc_id, source, lang, text_sha256) of the lines of the listed files; source and language by their folders."""
    lines = walk.with_content(listing).select("path", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
    row = lines.select("path", F.from_json("line", "doc_id long, text string").alias("r"))
    part = lambda name: F.nullif(F.regexp_extract("path", f"/{name}=([^/]*)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(name)
    return row.select("r.doc_id", part("source"), part("lang"), F.sha2("r.text", 256).alias("text_sha256"))


@query("SELECT doc_id, source, lang, sha256(text) AS text_sha256 FROM documents")
def walked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk of all folders, and the files that it let through, read by the tasks."""
    return _read(walk.walk(spark, [_written(spark, sf_dir)]))


@query("SELECT doc_id, source, lang, sha256(text) AS text_sha256 FROM documents WHERE source = (SELECT min(source) FROM documents)")
def changed_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A targeted scan of one source; a folder inside it must not count twice, an excluded one not at all."""
    root = _written(spark, sf_dir)
    held = table(spark, sf_dir, "documents").agg(F.min("source").alias("source"), F.max("lang").alias("lang")).first()
    source = f"{root}/docs/source={held.source}"
    return _read(walk.walk(spark, [root], [source, f"{source}/lang={held.lang}", f"{root}/node_modules", f"{root}/docs/source="]))
