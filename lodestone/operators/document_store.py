"""Catalog of documents as a merge-on-read store: a batch writes what it changes, in the buckets that it touches.

Rows lie in buckets by hash of their identity, and owners of paths in buckets by hash of the path. A batch reads
the buckets of its identities and paths, and appends rows to them; a row of a later version replaces earlier ones
of its identity. One manifest a version lists the folders of each bucket and is written last, by compare and set: a batch
that dies leaves the version before it, and of two writers one wins. Compaction merges the folders of buckets that have
many; folders that no kept version lists are removed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.operators.catalog_state import deduplicated_scan
from lodestone.sources.manifest import Conflict, Manifest

#: Buckets of either table, and folders of a bucket before it is merged.
BUCKETS, FOLDERS = 64, 8
ROWS = "identity string, document_id long, path string, body string, bytes long, revision long, seen long, gone boolean, mark boolean, version long"
OWNERS = "path string, identity string, gone boolean, version long"
COLUMNS = ["document_id", "identity", "path", "body", "bytes", "revision", "seen"]


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with numbers from 1 in the order of a column: a range sort, then one count a task."""
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_t", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND((1 << 33) - 1))
    held = scratch.saved(dealt, "numbered")
    before, starts = 0, []
    for r in held.groupBy("_t").agg(F.count("*").alias("n")).orderBy("_t").collect():
        starts.append((r._t, before))
        before += r.n
    begins = rows.sparkSession.createDataFrame(starts, "_t long, _before long")
    # as many rows as the sort had tasks
    return held.join(F.broadcast(begins), "_t").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_t", "_at", "_before")


class DocumentStore:
    """document_id, identity, path, body, bytes, revision, seen; ids are never given twice, not even after ``erase``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.manifest = Manifest(spark, f"{self.path}/versions")

    def state(self) -> dict:
        empty = {"batch": -1, "top": 0, "rows": {}, "owners": {}, "erasing": None, "scans": 0}
        return empty | self.manifest.read()

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _stored(self, state: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        """All stored rows of a table's buckets, each folder read from its own."""
        schema = ROWS if table == "rows" else OWNERS
        folders = sorted({f"{folder}/bucket={b}" for b, held in state[table].items() if buckets is None or int(b) in buckets for folder in held})
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    @staticmethod
    def _newest(stored: DataFrame, key: str) -> DataFrame:
        """The latest row of each key, without those that are gone; marks only say when a row was seen last."""
        fields = [c for c in stored.columns if c not in (key, "version", "mark")]
        if "mark" not in stored.columns:
            one = stored.groupBy(key).agg(F.max_by(F.struct(*fields), "version").alias("r"))
            return one.select(key, "r.*").where("not gone").drop("gone")
        one = stored.groupBy(key).agg(F.max_by(F.struct(*fields), F.when(~F.col("mark"), F.col("version"))).alias("r"), F.max("seen").alias("_seen"))
        rows = one.where("r is not null and not r.gone").select(key, "r.*", "_seen")
        return rows.withColumn("seen", F.greatest("seen", "_seen")).drop("gone", "_seen")

    def read(self, version: int | None = None) -> DataFrame:
        """The catalog at a version that is kept, or at the newest."""
        state = self.state() if version is None else self.state() | self.manifest.read(version)
        return self._newest(self._stored(state, "rows"), "identity").select(COLUMNS)

    def _append(self, state: dict, table: str, rows: DataFrame) -> tuple[dict[str, list[str]], list[int]]:
        """Write rows in folders by bucket; the table's folders with them, and the buckets that got some."""
        folder = f"data/{table}-{scratch.fresh(self.spark, '').rsplit('-', 1)[1]}"
        # eight tasks a bucket, so that a first load of everything is not as many tasks as there are buckets
        rows.repartition("bucket", F.pmod(F.xxhash64("identity"), F.lit(8 * self.buckets))).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        touched = [int(n.split("=")[1]) for n in scratch.listed(self.spark, f"{self.path}/{folder}") if n.startswith("bucket=")]
        return {**state[table], **{str(b): [*state[table].get(str(b), []), folder] for b in touched}}, touched

    def apply(self, changes: DataFrame, batch_id: int) -> bool:
        """Upsert changes(identity, path, body, bytes); False for a batch that was applied already.

        Known identities keep their id and gain a revision if anything changed; another identity that held a changed path
        goes; new identities get ids above all that ever were, in the order of the identities. Conflict if another writer
        commits meanwhile, and then nothing of this batch is seen.
        """
        state = self.state()
        if state["erasing"] is not None:
            raise Conflict("the store is being erased")
        if batch_id <= state["batch"]:
            return False
        version = state["version"] + 1
        new = scratch.saved(deduplicated_scan(changes.where("identity is not null and path is not null")).select("identity", "path", "body", F.col("bytes").cast("long").alias("bytes")), "store-changes")
        wanted = lambda column: [r.b for r in new.select(self._bucket(column).alias("b")).distinct().collect()]  # noqa: E731  at most as many as buckets
        owners = self._newest(self._stored(state, "owners", wanted("path")), "path")
        # who held a path of the batch and is not the one that comes with it
        out = owners.withColumnRenamed("identity", "owner").join(new.select("path", "identity"), "path").where("owner <> identity").select(F.col("owner").alias("identity"), "path")
        # an owner that itself moves to another path in this batch stays
        evicted = scratch.saved(out.join(new.select("identity"), "identity", "left_anti"), "store-evicted")
        near = sorted({*wanted("identity"), *[r.b for r in evicted.select(self._bucket("identity").alias("b")).distinct().collect()]})
        held = scratch.saved(self._newest(self._stored(state, "rows", near), "identity"), "store-held")
        old = held.select("identity", *[F.col(c).alias(f"o_{c}") for c in ("document_id", "path", "body", "bytes", "revision")])
        both = new.join(old, "identity", "left")
        same = F.col("o_path").eqNullSafe(F.col("path")) & F.col("o_body").eqNullSafe(F.col("body")) & F.col("o_bytes").eqNullSafe(F.col("bytes"))
        known = both.where("o_document_id is not null").select("identity", F.col("o_document_id").alias("document_id"), "path", F.when(~same, F.col("body")).alias("body"), "bytes", (F.col("o_revision") + F.when(same, 0).otherwise(1)).alias("revision"), same.alias("mark"))
        fresh = numbered(both.where("o_document_id is null").select("identity", "path", "body", "bytes"), "identity", "_n")
        added = fresh.select("identity", (F.lit(state["top"]) + F.col("_n")).alias("document_id"), "path", "body", "bytes", F.lit(1).cast("long").alias("revision"), F.lit(False).alias("mark"))
        lost = evicted.select("identity").distinct().join(held, "identity").select("identity", "document_id", "path", F.lit(None).cast("string").alias("body"), "bytes", "revision")
        seen = F.lit(batch_id).cast("long").alias("seen")
        live = known.unionByName(added).select("*", seen, F.lit(False).alias("gone"))
        dead = lost.select("*", F.lit(False).alias("mark"), seen, F.lit(True).alias("gone"))
        written = live.unionByName(dead).select("identity", "document_id", "path", "body", "bytes", "revision", "seen", "gone", "mark", F.lit(version).cast("long").alias("version"), self._bucket("identity").alias("bucket"))
        # paths that a known identity left have no owner, unless another took them in this batch
        left = both.where("o_path is not null and o_path <> path").select(F.col("o_path").alias("path"), "identity").join(new.select("path"), "path", "left_anti").withColumn("gone", F.lit(True))
        took = both.where(~F.coalesce(F.col("o_path") == F.col("path"), F.lit(False))).select("path", "identity", F.lit(False).alias("gone"))
        owned = took.unionByName(left).select("path", "identity", "gone", F.lit(version).cast("long").alias("version"), self._bucket("path").alias("bucket"))
        rows, _ = self._append(state, "rows", written)
        paths, _ = self._append(state, "owners", owned)
        top = state["top"] + both.where("o_document_id is null").count()
        self.manifest.commit(state, rows=rows, owners=paths, top=top, batch=batch_id)
        scratch.let_go(new, evicted, held)
        return True

    def finish_scan(self, generation: int, complete: bool, below: str | None = None) -> int:
        """Remove what a complete scan did not see (in a folder, if given); the number of rows. An interrupted scan removes nothing."""
        state = self.state()
        if not complete:
            return 0
        gone = self.read().where(F.col("seen") != generation)
        if below is not None:
            gone = gone.where((F.col("path") >= f"{below}/") & (F.col("path") < f"{below}0"))
        return self._remove(state, gone, scans=state["scans"] + 1)

    def _remove(self, state: dict, rows: DataFrame, **also) -> int:
        """Tombstones for rows, in their buckets alone."""
        rows = scratch.saved(rows.select("identity", "document_id", "path"), "store-gone")
        n, version = rows.count(), F.lit(state["version"] + 1).cast("long").alias("version")
        none = {c: F.lit(None).cast(kind).alias(c) for c, kind in (("body", "string"), ("bytes", "long"), ("revision", "long"), ("seen", "long"))}
        dead = rows.select("identity", "document_id", "path", *none.values(), F.lit(True).alias("gone"), F.lit(False).alias("mark"), version, self._bucket("identity").alias("bucket"))
        free = rows.select("path", "identity", F.lit(True).alias("gone"), version, self._bucket("path").alias("bucket"))
        self.manifest.commit(state, rows=self._append(state, "rows", dead)[0], owners=self._append(state, "owners", free)[0], **also)
        scratch.let_go(rows)
        return n

    def compact(self, folders: int = FOLDERS) -> list[int]:
        """Merge the buckets that have more than so many folders into one each; their numbers."""
        state, changed, merged = self.state(), {}, []
        for table, key in (("rows", "identity"), ("owners", "path")):
            many = [int(b) for b, held in state[table].items() if len(held) > folders]
            if not many:
                continue
            rows = self._newest(self._stored(state, table, many), key).withColumn("gone", F.lit(False)).withColumn("version", F.lit(state["version"] + 1).cast("long")).withColumn("bucket", self._bucket(key))
            if table == "rows":
                rows = rows.withColumn("mark", F.lit(False))
            kept = {**state, table: {b: held for b, held in state[table].items() if int(b) not in many}}
            changed[table], _ = self._append(kept, table, rows)
            merged += many
        if changed:
            self.manifest.commit(state, **changed)
        return sorted(set(merged))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove manifests but the newest ``keep``, and folders that none of those lists; names of the folders.

        Run it when no batch is being written: a folder of a batch in the making is in no manifest yet.
        """
        self.manifest.forget(keep)
        listed = {f for v in self.manifest.versions() for table in ("rows", "owners") for held in self.manifest.read(v)[table].values() for f in held}
        gone = [f"data/{n}" for n in scratch.listed(self.spark, f"{self.path}/data") if f"data/{n}" not in listed]
        for f in gone:
            scratch.delete(self.spark, f"{self.path}/{f}")
        return gone

    def erase(self, page: int = 8, pages: int | None = None) -> bool:
        """Empty the store a page of buckets at a time, each committed; True when it is empty.

        Stopped after some pages it goes on where it was. Writers are refused meanwhile; the next id and the count of scans stay.
        """
        for _ in range(pages if pages is not None else math.ceil(self.buckets / page) + 1):
            state = self.state()
            begin = state["erasing"] or 0
            if begin >= self.buckets:
                self.manifest.commit(state, erasing=None)
                return True
            left = {table: {b: held for b, held in state[table].items() if int(b) >= begin + page} for table in ("rows", "owners")}
            self.manifest.commit(state, **left, erasing=begin + page)
        return False

    def stream(self, changes: DataFrame, checkpoint: str):
        """Apply a stream of changes, everything available now; a micro-batch that is retried is applied once."""
        return changes.writeStream.foreachBatch(lambda df, n: self.apply(df, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
