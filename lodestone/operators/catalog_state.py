"""Incremental catalog: upserts, tombstones, revision fences, model generations, clip history."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIPS_KEPT, CLIP_BYTES, PINS, TEXT_BYTES, IMAGE_BYTES = 200, 256 << 20, 100, 1 << 20, 25 << 20
UNCHANGED = ("identity", "path", "modified_ns", "changed_ns", "bytes", "passage_version")


def deduplicated_scan(scan: DataFrame) -> DataFrame:
    """One row per identity (hard links keep the first path) and then per path (the last identity wins)."""
    first = Window.partitionBy("identity").orderBy("path")
    one = scan.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    last = Window.partitionBy("path").orderBy(F.desc("identity"))
    return one.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def unchanged(catalog: DataFrame, scan: DataFrame, columns: tuple[str, ...] = UNCHANGED) -> DataFrame:
    """Scanned rows whose metadata all equal the catalog's: nothing to read again."""
    return scan.join(catalog.select(*columns), list(columns), "left_semi")


def upsert(catalog: DataFrame, changes: DataFrame, generation: int) -> DataFrame:
    """catalog(document_id, identity, path, body, bytes, revision, seen) after changes(identity, path, body, bytes).

    Known identities keep their id and gain a revision if anything changed; another identity that held a
    changed path goes; new identities get distinct ids above all that the catalog holds, without gaps. Nothing
    else is touched, and rows that are not in the changes keep what they saw last.
    """
    new = deduplicated_scan(changes).select("identity", *[F.col(c).alias(f"n_{c}") for c in ("path", "body", "bytes")])
    taken = new.select(F.col("n_path").alias("path"), F.col("identity").alias("owner"))
    kept = catalog.join(taken, "path", "left").where(F.col("owner").isNull() | (F.col("owner") == F.col("identity"))).drop("owner")
    both = kept.join(new, "identity", "full")
    differs = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in ("path", "body", "bytes")])
    old = both.where("document_id is not null").select(
        "document_id",
        "identity",
        *[F.when(F.col("n_path").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("path", "body", "bytes")],
        (F.col("revision") + F.when(F.col("n_path").isNotNull() & differs, 1).otherwise(0)).alias("revision"),
        F.when(F.col("n_path").isNotNull(), F.lit(generation)).otherwise(F.col("seen")).cast("long").alias("seen"),
    )
    fresh = both.where("document_id is null").select("identity", *[F.col(f"n_{c}").alias(c) for c in ("path", "body", "bytes")])
    top = catalog.agg(F.coalesce(F.max("document_id"), F.lit(0)).alias("top"))
    numbered = with_dense_ids(fresh, "identity", "offset").join(top)
    added = numbered.select((F.col("top") + F.col("offset")).alias("document_id"), "identity", "path", "body", "bytes", F.lit(1).cast(catalog.schema["revision"].dataType).alias("revision"), F.lit(generation).cast("long").alias("seen"))
    return old.unionByName(added)


def with_dense_ids(rows: DataFrame, order: str, name: str, buckets: int = 256) -> DataFrame:
    """Numbers from 1 without gaps, without moving all rows to one task: counts of hash buckets of a key come first.

    Numbers follow the bucket, then the key: the same keys always get the same numbers, but not in key order.
    """
    bucket = F.pmod(F.xxhash64(order), F.lit(buckets))
    counts = rows.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_b", "_before")
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return rows.withColumn("_b", bucket).join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + inside).drop("_b", "_before")


def finish_scan(catalog: DataFrame, generation: int, complete: bool, folder: Column | None = None) -> DataFrame:
    """Rows that a finished scan did not see go; an interrupted scan removes nothing. ``folder`` limits the scan."""
    if not complete:
        return catalog
    gone = F.col("seen") != generation
    return catalog.where(~(gone if folder is None else gone & folder))


def retain_roots(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    return catalog.join(roots.select("root").distinct(), "root", "left_semi")


def keep_differences(held: DataFrame, keep: DataFrame, key: str = "id") -> DataFrame:
    """(key, side) where the two sets differ: ``prune`` is held but not to be kept, ``missing`` is to be kept but not held. Null keys are in neither set."""
    a, b = held.where(F.col(key).isNotNull()).select(key).distinct(), keep.where(F.col(key).isNotNull()).select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("prune")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("missing")))


def extraction_failed(catalog: DataFrame, failures: DataFrame) -> DataFrame:
    """catalog with failures(identity, code); the body that was there stays."""
    return catalog.join(failures.select("identity", "code"), "identity", "left").withColumn("extraction", F.coalesce("code", "extraction")).withColumn("body", F.coalesce("body", F.lit(""))).drop("code")


def children(parents: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is still there."""
    return rows.join(parents.select(key).distinct(), key, "left_semi")


def pending(documents: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Documents without a vector of this model and revision."""
    have = vectors.where(F.col("model") == model).select("document_id", "revision")
    return documents.join(have, ["document_id", "revision"], "left_anti")


#: Rows of the larger side of a join that a task sorts.
JOIN_ROWS = 1 << 21


def _dealt(keys: list[str], *sides: DataFrame) -> tuple[DataFrame, ...]:
    """The sides of a join by its keys, over so many tasks that the rows of one don't grow with the tables."""
    spark = sides[0].sparkSession
    tasks = max(-(-side.count() // JOIN_ROWS) for side in sides)
    if tasks <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return sides
    return tuple(side.repartition(tasks, *keys) for side in sides)


def fenced(results: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, stale) of results(document_id, revision, ...): late work on an older revision is dropped."""
    now = documents.select("document_id", "revision")
    results, now = _dealt(["document_id", "revision"], results, now)
    return results.join(now, ["document_id", "revision"], "left_semi"), results.join(now, ["document_id", "revision"], "left_anti")


def activate_model(models: DataFrame, model: str, stale: int, vectors: int) -> DataFrame:
    """models(model, active): exactly one active; a pass with stale or without vectors changes nothing."""
    if stale or not vectors:
        return models
    return models.withColumn("active", F.col("model") == model)


def retired_bytes(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """Bytes and rows of vectors whose model is not active."""
    old = vectors.join(models.where("active").select("model"), "model", "left_anti")
    return old.agg(F.count("*").alias("vectors"), F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("bytes"))


def compacted(vectors: DataFrame, models: DataFrame) -> DataFrame:
    return vectors.join(models.where("active").select("model"), "model", "left_semi")


def integrity(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(check, violations): unique paths and identities, no orphans, unique ordinals."""
    twice = lambda df, *c: df.groupBy(*c).count().where("count > 1").agg(F.count("*").alias("violations"))
    orphans = passages.join(documents, "document_id", "left_anti").agg(F.count("*").alias("violations"))
    parts = {"path": twice(documents, "path"), "identity": twice(documents, "identity"), "orphan": orphans, "ordinal": twice(passages, "document_id", "ordinal")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("check"), "violations") for name, df in parts.items()])


def clip_history(events: DataFrame, keep: int = CLIPS_KEPT, most_bytes: int = CLIP_BYTES, by: str = "user_id") -> DataFrame:
    """History after replaying events(user_id, at, action, content, bytes): one row per distinct content.

    add and touch move a content to the front, pin and unpin mark it, remove takes it out. Unpinned rows
    are kept while they are among the ``keep`` newest and all newer rows, pinned ones included, fit the bytes.
    """
    digest = F.unhex(F.sha2("content", 256))
    rows = events.where(F.col("bytes") <= TEXT_BYTES).withColumn("clip", digest)
    order = F.struct("at", "action")
    state = rows.groupBy(by, "clip").agg(
        F.max_by("content", order).alias("content"),
        F.max("bytes").alias("bytes"),
        F.max(F.when(F.col("action").isin("add", "touch"), F.col("at"))).alias("front"),
        F.max(F.when(F.col("action") == "remove", F.col("at"))).alias("removed"),
        F.max_by(F.col("action") == "pin", F.when(F.col("action").isin("pin", "unpin"), F.col("at"))).alias("pinned"),
    )
    live = state.where(F.col("front").isNotNull() & (F.col("removed").isNull() | (F.col("front") > F.col("removed")))).withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    newest = Window.partitionBy(by, "pinned").orderBy(F.desc("front"), "clip")
    ranked = live.withColumn("n", F.row_number().over(newest)).where(F.col("pinned") | (F.col("n") <= keep))
    # pins never go, so they use up bytes first
    pins = F.sum(F.when(F.col("pinned"), F.col("bytes")).otherwise(0)).over(Window.partitionBy(by))
    used = F.sum("bytes").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", F.when(F.col("pinned"), 0).otherwise(pins + used)).where(F.col("pinned") | (F.col("used") <= most_bytes)).drop("n", "used", "removed")


def clip_order(history: DataFrame) -> DataFrame:
    """Pinned first, then newest."""
    return history.orderBy(F.desc("pinned"), F.desc("front"), "clip")


def last_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


def bounded_log(log: DataFrame, by: str, order: str, n_lines: int, most_bytes: int = 1 << 20) -> DataFrame:
    """Newest lines of each group, bounded in number and bytes."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    rows = log.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.sum(F.octet_length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("_n") <= n_lines) & (F.col("_b") <= most_bytes)).drop("_n", "_b")


def cpu_percent(samples: DataFrame) -> DataFrame:
    """samples(pid, t, cpu in seconds) with percent since the sample before; null first, never negative."""
    w = Window.partitionBy("pid").orderBy("t")
    dt, dc = F.col("t") - F.lag("t").over(w), F.col("cpu") - F.lag("cpu").over(w)
    return samples.withColumn("percent", F.when(dt > 0, F.greatest(F.lit(0.0), dc / dt * 100)))


def carried_forward(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """The last non-null value so far."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """left with the value of the latest row of right at or before its time: one sort of the union by key."""
    tagged = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    marks = right.select(by, time, F.col(value).alias("_value")).withColumn("_side", F.lit(0))
    both = tagged.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_value")
