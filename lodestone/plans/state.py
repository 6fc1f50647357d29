"""Plans over changing data: pending work, upserts, tombstones, histories, as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.operators import catalog_state as state
from lodestone.operators import fusion, inventory
from lodestone.operators.document_store import DocumentStore
from lodestone.operators.embedding_pass import EmbeddingPass
from lodestone.operators.ranking import merged_lanes
from lodestone.plans.registry import epoch, query, table
from lodestone.sources import listings
from lodestone.sources.manifest import Conflict, Generations
from lodestone.streaming import queues as bounded


@query("SELECT d.doc_id AS document_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand in for vectors: documents without one are still to do."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("revision"), "n_chars")
    v = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("revision"), F.lit("m").alias("model"))
    return state.pending(d, v, "m").select("document_id", "n_chars")


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Unlabelled documents as the catalog; labelled ones and the short unlabelled ones as changes, some of them edited."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = d.select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("identity"), F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("body"), F.col("n_chars").alias("bytes"), "quality", "doc_id")
    catalog = rows.where("quality is null").select((F.col("doc_id") + 1).alias("document_id"), "identity", "path", "body", "bytes", F.lit(1).cast("long").alias("revision"), F.lit(1).cast("long").alias("seen"))
    changed = rows.where("quality is not null or bytes < 1000").select("identity", "path", F.when(F.col("quality").isNull() & (F.col("bytes") < 500), F.lit("edited")).otherwise(F.col("body")).alias("body"), "bytes")
    return catalog, changed


_CATALOG = """d AS (SELECT 'i' || doc_id AS identity, '/' || source || '/' || doc_id AS path, sha256(text) AS body, n_chars AS bytes, quality, doc_id FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)),
c AS (SELECT doc_id + 1 AS document_id, identity, path, body, bytes FROM d WHERE quality IS NULL),
n AS (SELECT identity, path, CASE WHEN quality IS NULL AND bytes < 500 THEN 'edited' ELSE body END AS body, bytes FROM d WHERE quality IS NOT NULL OR bytes < 1000),
u AS (SELECT document_id, identity, coalesce(n.body, c.body) AS body, CASE WHEN n.body <> c.body THEN 2 ELSE 1 END AS revision, CASE WHEN n.identity IS NULL THEN 1 ELSE 2 END AS seen FROM c LEFT JOIN n USING (identity)
UNION ALL SELECT NULL, identity, body, 1, 2 FROM n WHERE identity NOT IN (SELECT identity FROM c))"""


@query(f"WITH {_CATALOG} SELECT document_id AS known_id, identity, body, revision::BIGINT AS revision, seen::BIGINT AS seen FROM u")
def cdc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New identities get fresh ids above all others; known_id shows ids that were kept."""
    catalog, changed = _catalog(spark, sf_dir)
    top = catalog.agg(F.max("document_id").alias("top"))
    out = state.upsert(catalog, changed, 2).join(top)
    return out.select(F.when(F.col("document_id") <= F.col("top"), F.col("document_id")).alias("known_id"), "identity", "body", "revision", "seen")


@query(f"WITH {_CATALOG} SELECT identity, revision::BIGINT AS revision FROM u WHERE seen = 2")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a complete second scan only what it saw is left."""
    catalog, changed = _catalog(spark, sf_dir)
    return state.finish_scan(state.upsert(catalog, changed, 2), 2, True).select("identity", "revision")


@query(
    """WITH e AS (SELECT conv_id, sha256(coalesce(text, '')) AS clip, max(turn) AS front FROM conversations WHERE strlen(coalesce(text, '')) <= 1048576 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY front DESC, clip) AS n FROM e) SELECT conv_id AS user_id, clip, front, n AS place FROM r WHERE n <= 4"""
)
def clip_history_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as clips of their conversation; the four newest distinct ones stay."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("at"), F.lit("add").alias("action"), F.coalesce("text", F.lit("")).alias("content"))
    kept = state.clip_history(c.withColumn("bytes", F.octet_length("content").cast("long")), keep=4)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("front"), "clip"))
    return kept.select("user_id", F.lower(F.hex("clip")).alias("clip"), "front", place.alias("place"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of the last question before each turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked"))
    return state.carried_forward(c, "conv_id", "turn", "asked")


@query(
    """WITH p AS (SELECT user_id, ts, max(event_id) AS bought FROM events WHERE event_type = 'purchase' GROUP BY ALL), v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT v.event_id, v.user_id, p.bought FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.ts >= p.ts"""
)
def asof_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's latest purchase at each view."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("bought"))
    return state.as_of(views, bought, "user_id", "ts", "bought").select("event_id", "user_id", "bought")


@query(
    """WITH l AS (SELECT l_orderkey AS pid, l_linenumber AS t, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS cpu FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity))
SELECT pid, t, CASE WHEN lag(cpu) OVER w IS NOT NULL THEN round(greatest(0, (cpu - lag(cpu) OVER w) / (t - lag(t) OVER w) * 100), 6) END AS percent FROM l WINDOW w AS (PARTITION BY pid ORDER BY t)"""
)
def cpu_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as samples of a growing counter."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("t"), "l_quantity")
    one = li.groupBy("pid", "t").agg(F.min("l_quantity").alias("q"))
    grown = one.withColumn("cpu", F.sum("q").over(Window.partitionBy("pid").orderBy("t")))
    return state.cpu_percent(grown).select("pid", "t", F.round("percent", 6).alias("percent"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_n(table(spark, sf_dir, "events"), "user_id", "event_id", 5).select("user_id", "event_id", "ts")


@query(
    """SELECT 'identity' AS "check", (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'path', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'orphan', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))
UNION ALL SELECT 'ordinal', (SELECT count(*) FROM (SELECT doc_id, quality FROM labels GROUP BY ALL HAVING count(*) > 1))"""
)
def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their text as path, and labels as passages: copies show up as violations."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("identity"), F.col("text").alias("path"))
    p = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").alias("ordinal"))
    return state.integrity(d, p)


@query("SELECT l_partkey, l_suppkey, l_quantity FROM (SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_discount < 0.05 EXCEPT ALL SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_quantity < 25)")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one table version that another lacks, with multiplicity."""
    li = table(spark, sf_dir, "lineitem")
    columns = ["l_partkey", "l_suppkey", "l_quantity"]
    return li.where("l_discount < 0.05").select(columns).exceptAll(li.where("l_quantity < 25").select(columns))


@query("SELECT count(*) AS n, true AS shuffled, false AS shorter FROM lineitem WHERE l_discount < 0.05")
def bag_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a table equals itself in another order and column order, and itself without one of its rows."""
    li = table(spark, sf_dir, "lineitem").where("l_discount < 0.05").select("l_partkey", "l_suppkey", "l_quantity")
    other = li.repartition(7).select("l_quantity", "l_partkey", "l_suppkey")
    some = li.limit(1)
    shuffled, shorter = inventory.same_rows(li, other), inventory.same_rows(li, li.exceptAll(some))
    return li.agg(F.count("*").alias("n")).select("n", F.lit(shuffled).alias("shuffled"), F.lit(shorter).alias("shorter"))


@query("SELECT user_id AS pid, 'cmd' || user_id AS command, CASE WHEN user_id % 2 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol, '127.0.0.1:' || event_id AS address FROM events WHERE user_id > 0")
def socket_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as tagged lines, one dump a user, and parsed back."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("n127.0.0.1:"), F.col("event_id").cast("string")))), "\n").alias("names"))
    head = F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit("\nccmd"), F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, "\nPUDP\n").otherwise("\nPTCP\n"))
    dumps = e.select(F.col("user_id").cast("string").alias("source"), F.concat(head, "names").alias("text"))
    return listings.sockets(dumps).select("pid", "command", "protocol", "address")


@query("SELECT id, kind, first_lane AS lane FROM (SELECT n_nationkey AS id, n_name AS kind, 0 AS first_lane FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, n_name, 1 FROM nation WHERE n_nationkey >= 10)")
def lanes_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:


    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("kind"), F.col("n_nationkey").alias("position"))
    return merged_lanes(n.where("id < 10"), n).select("id", "kind", "lane")


@query("SELECT count(*) FILTER (vec_id <= 200) AS inside, count(*) FILTER (vec_id > 200) AS beyond, max(vec_id) AS last, (210 - count(*) FILTER (vec_id <= 200)) * 10 <= 210 AND count(*) FILTER (vec_id > 200) <= 2048 AS reusable FROM embeddings")
def shard_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.shard_state(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), 200, 210)


@query()
def best_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 300-byte window of every document for its source's and language's name and two common words."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.col("text").alias("body"), F.array(F.lit("the"), F.lit("and"), "lang").alias("terms"))
    return fusion.best_windows(rows, 300)


def _customer_batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three batches of customers as documents: two thirds of them, every other one, and other identities on a fifth of the paths."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    path, key = F.concat(F.lit("/"), F.col("k").cast("string")), F.col("k").cast("string")
    row = lambda identity, body: [identity.alias("identity"), path.alias("path"), body.alias("body"), F.octet_length(body).alias("bytes")]
    louder = F.concat("segment", F.when(F.col("k") % 4 == 0, "!").otherwise(""))
    return [c.where("k % 3 <> 0").select(row(key, F.col("segment"))), c.where("k % 2 = 0").select(row(key, louder)), c.where("k % 5 = 0").select(row(F.concat(F.lit("new"), key), F.lit("moved")))]


_STORED = """c AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS i, c_mktsegment AS s FROM customer),
a AS (SELECT k, i, s, row_number() OVER (ORDER BY i) AS id FROM c WHERE k % 3 <> 0),
b AS (SELECT k, i, s, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY i) AS id FROM c WHERE k % 2 = 0 AND k % 3 = 0),
two AS (SELECT k, i, id, CASE WHEN k % 4 = 0 THEN s || '!' ELSE s END AS body, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS revision, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS seen FROM a UNION ALL SELECT k, i, id, CASE WHEN k % 4 = 0 THEN s || '!' ELSE s END, 1, 2 FROM b)"""


@query(
    f"""WITH {_STORED}, three AS (SELECT 'new' || i AS identity, k, (SELECT count(*) FROM two) + row_number() OVER (ORDER BY 'new' || i) AS id FROM c WHERE k % 5 = 0)
SELECT id AS document_id, i AS identity, '/' || k AS path, body, strlen(body) AS bytes, revision::BIGINT AS revision, seen::BIGINT AS seen FROM two WHERE k % 5 <> 0
UNION ALL SELECT id, identity, '/' || k, 'moved', 5, 1, 3 FROM three"""
)
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge-on-read store after three batches and a merge of its folders: ids, revisions and who was displaced."""
    store = DocumentStore(spark, scratch.fresh(spark, "store"), buckets=8)
    for n, batch in enumerate(_customer_batches(spark, sf_dir), 1):
        store.apply(batch, n)
    store.apply(_customer_batches(spark, sf_dir)[1], 2)  # a retried batch changes nothing
    store.compact(folders=2)
    return store.read()


@query(f"WITH {_STORED} SELECT id AS document_id, i AS identity, revision::BIGINT AS revision, seen::BIGINT AS seen FROM two WHERE seen = 2 OR k >= 500")
def store_after_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete scan of the paths below /1 to /499, which are moved into a folder, drops what the second batch did not see."""
    store = DocumentStore(spark, scratch.fresh(spark, "store"), buckets=8)
    for n, batch in enumerate(_customer_batches(spark, sf_dir)[:2], 1):
        store.apply(batch.withColumn("path", F.when(F.substring("path", 2, 12).cast("int") < 500, F.concat(F.lit("/low"), "path")).otherwise(F.col("path"))), n)
    store.finish_scan(2, complete=False)
    store.finish_scan(2, complete=True, below="/low")
    return store.read().select("document_id", "identity", "revision", "seen")


@query("SELECT 'label-' || label AS shard, count(*) AS n, max(vec_id) AS last FROM embeddings WHERE vec_id > 0 GROUP BY label")
def published_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards by label of the model that is active after another was; a builder that read older vectors is refused."""
    g = Generations(spark, scratch.fresh(spark, "generations"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label").where("id > 0")
    for model in ("first", "second"):
        g.begin(model)
        g.activate(model, 0, 1)
    # as many shards as labels
    for r in rows.groupBy("label").agg(F.count("*").alias("count"), F.max("id").alias("last")).collect():
        of = rows.where(F.col("label") == r.label)
        g.publish("second", f"label-{r.label}", f"shards/{r.label}", {"count": r["count"], "last": r.last}, of)
        try:
            g.publish("second", f"label-{r.label}", "stale", {"count": r["count"] - 1, "last": r.last}, of)
        except Conflict:
            continue
    g.retire()
    return spark.createDataFrame([(name, s["count"], s["last"]) for name, s in g.shards().items()], "shard string, n long, last long")


@query(
    """WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents),
c AS (SELECT id, contains(t, 'icen') AS unreadable, (length(t) - length(replace(t, 'a', '')))::DOUBLE AS a, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS e FROM t),
f AS (SELECT *, NOT unreadable AND a + e > 0 AS good FROM c)
SELECT id, good AS embedded, CASE WHEN good THEN round((a / sqrt(a * a + e * e))::FLOAT::DOUBLE, 4) END AS first, CASE WHEN good THEN round((e / sqrt(a * a + e * e))::FLOAT::DOUBLE, 4) END AS second FROM f"""
)
def embedding_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass over all documents in eight pages, stopped after three and taken up again; the model counts two letters and can't read some texts."""

    def model(texts: list[str]) -> list[list[float]]:
        if any("icen" in t for t in texts):
            raise ValueError("unreadable")
        return [[float(t.count("a")), float(t.count("e"))] for t in texts]

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("revision"), "text")
    page = -(-rows.count() // 8)
    path = scratch.fresh(spark, "embeddings")
    EmbeddingPass(spark, path, "letters", 2, page).run(rows, model, budget=3)
    again = EmbeddingPass(spark, path, "letters", 2, page)
    again.run(rows, model)
    v = again.vectors()
    return v.select("id", F.col("error").isNull().alias("embedded"), *[F.round(F.col("vector")[i].cast("double"), 4).alias(n) for i, n in enumerate(("first", "second"))])


@query(
    """WITH RECURSIVE e AS (SELECT event_type AS root, epoch_us(ts) // 1000000 AS t, user_id::VARCHAR AS path, event_id % 97 = 0 AS dropped FROM events),
f AS (SELECT root, min(t) AS start, min(t) + 2000 AS due FROM e GROUP BY root
  UNION ALL SELECT n.root, n.start, n.start + greatest(2000, 10000 - (n.start - n.flushed)) FROM (SELECT f.root, min(e.t) AS start, f.due AS flushed FROM f JOIN e ON e.root = f.root AND e.t >= f.due GROUP BY f.root, f.due) n)
SELECT f.root, f.due AS "at", bool_or(dropped) OR count(DISTINCT path) > 5 AS "full", CASE WHEN bool_or(dropped) OR count(DISTINCT path) > 5 THEN '' ELSE string_agg(DISTINCT path, ',' ORDER BY path) END AS paths
FROM f JOIN e ON e.root = f.root AND e.t >= f.start AND e.t < f.due GROUP BY f.root, f.due"""
)
def file_event_flushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed as changes below their type, a thousand times as fast: which paths each flush names, or a full scan above five."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("root"), epoch().alias("at"), F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 97 == 0).alias("dropped"))
    return bounded.file_event_flushes(e, 5).select("root", "at", "full", F.array_join("paths", ",").alias("paths"))


_QUEUE = """WITH e AS (SELECT {key} AS key, {at} AS t, {size} AS size, {item} AS item FROM {table} WHERE {size} <= {largest}),
n AS (SELECT *, row_number() OVER w AS back, sum(size) OVER w AS bytes FROM e WINDOW w AS (PARTITION BY key ORDER BY t DESC, size DESC, item DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM n WHERE back <= {count} AND bytes <= {most})
SELECT key, (row_number() OVER (PARTITION BY key ORDER BY back DESC))::INT AS place, t AS "at", size, item FROM k"""


@query(_QUEUE.format(key="lang", at="doc_id", size="strlen(coalesce(text, ''))", item="doc_id::VARCHAR", table="(SELECT * FROM documents WHERE lang IS NOT NULL)", largest=20000, count=16, most=60000))
def clip_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clips in a queue of each language: 16 clips and 60 000 bytes at most, clips above 20 000 refused."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("key"), F.col("doc_id").alias("at"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"), F.col("doc_id").cast("string").alias("item"))
    return bounded.queues(d, 16, 60_000, 20_000)


@query(_QUEUE.format(key="event_type", at="event_id", size="1", item="user_id::VARCHAR", table="events", largest=1, count=200, most=200))
def event_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 events of each type."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("at"), F.lit(1).alias("size"), F.col("user_id").cast("string").alias("item"))
    return bounded.queues(e, bounded.EVENTS, bounded.EVENTS, 1)
