"""Ranking and filter plans: tiers, fuzzy names, frecency, the typed filter language, scopes."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import usage
from lodestone.operators import filters, inventory, ranking
from lodestone.plans.registry import epoch, query, table

NOW = 1_706_572_800  # 2024-01-30 00:00:00 UTC, at the end of the events
_PATHS = """paths AS (SELECT doc_id AS document_id, '/' || source || '/' || lang || '/' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.pdf' WHEN 2 THEN '.rs' WHEN 3 THEN '.json' WHEN 4 THEN '.html' WHEN 5 THEN '.xlsx' ELSE '' END AS path,
n_chars AS bytes, 1706572800 - doc_id * 3600 AS modified, (doc_id % 6)::INT AS extraction, doc_id % 11 = 0 AS partial FROM documents)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a file catalog with derived paths, times and extraction codes."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 7
    ext = F.when(k == 0, ".md").when(k == 1, ".pdf").when(k == 2, ".rs").when(k == 3, ".json").when(k == 4, ".html").when(k == 5, ".xlsx").otherwise("")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), ext)
    return d.select(F.col("doc_id").alias("document_id"), path.alias("path"), F.col("n_chars").alias("bytes"), (NOW - F.col("doc_id") * 3600).alias("modified"), (F.col("doc_id") % 6).cast("int").alias("extraction"), (F.col("doc_id") % 11 == 0).alias("partial"))


@query(
    r"""WITH n AS (SELECT p_partkey, p_name, lower(p_name) AS n, regexp_replace(lower(p_name), '\.[^.]*$', '') AS stem FROM part), q AS (SELECT unnest(['red', 'widget', 'ing', 'small ring']) AS q)
SELECT q, p_partkey, CASE WHEN n = q OR stem = q THEN 5 WHEN starts_with(n, q) THEN 4 WHEN len(list_filter(string_split_regex(n, '[^\p{L}\p{N}]'), lambda w: starts_with(w, q))) > 0 THEN 3 WHEN contains(n, q) THEN 2 ELSE 1 END AS tier FROM n, q"""
)
def tier_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    asked = p.select("p_partkey", "p_name", F.explode(F.array(*map(F.lit, ["red", "widget", "ing", "small ring"]))).alias("q"))
    return asked.select("q", "p_partkey", ranking.tier(F.col("p_name"), F.col("q")).alias("tier"))


@query()
def fuzzy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    asked = spark.createDataFrame([(1, "rw"), (2, "smring"), (3, "blue"), (4, "xq")], "query_id long, text string")
    return ranking.rank_names(names, asked, 20)


@query(
    f"""WITH {_PATHS}, k AS (SELECT document_id, path, regexp_extract(path, '[^/]+$') AS name, path LIKE '/src1/%' AS own, len(string_split(path, '/')) - 1 AS parts, modified FROM paths),
t AS (SELECT *, CASE WHEN name = '10' OR regexp_replace(name, '[.][^.]*$', '') = '10' THEN 5 WHEN starts_with(name, '10') THEN 4 WHEN contains(name, '10') THEN 2 ELSE 1 END AS tier FROM k)
SELECT document_id, path, CASE WHEN own THEN 2 ELSE 1 END AS place, tier >= 3 AS strong, (modified >= 1706572800 - 30 * 86400)::INT AS used, own AND parts = 2 AS top_level, tier, own AS user_file, CASE WHEN own THEN 1 - parts ELSE -1 - parts END AS depth, -length(name) AS length, 0 AS fuzzy
FROM t ORDER BY place DESC, strong DESC, used DESC, top_level DESC, tier DESC, user_file DESC, depth DESC, length DESC, document_id LIMIT 50"""
)
def keyed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The launcher's order over the catalog for the query 'src1'."""
    d = paths(spark, sf_dir).withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    used = usage.usage_band(F.col("modified"), F.lit(NOW))
    k = ranking.key(F.col("name"), F.col("path"), F.lit(False), used, F.lit(0), F.lit("10"), "/src1")
    return d.select("document_id", "path", k.alias("key")).orderBy(F.desc("key"), "document_id").limit(50).select("document_id", "path", "key.*")


@query(
    """SELECT user_id, event_type, round(sum(power(0.5, greatest(0, (1706572800 - epoch_us(ts) // 1000000) / 86400.0) / 14.0)), 6) AS score FROM events GROUP BY ALL"""
)
def frecency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", epoch().alias("at"))
    return e.groupBy("user_id", "event_type").agg(F.round(usage.decayed_count(F.col("at"), F.lit(NOW)), 6).alias("score"))


@query(
    """WITH s AS (SELECT user_id, sum(power(0.5, greatest(0, (1706572800 - epoch_us(ts) // 1000000) / 86400.0) / 14.0)) AS score, max(epoch_us(ts) // 1000000) AS last FROM events GROUP BY ALL)
SELECT user_id, round(1 + 0.6 * score / (score + 3), 6) AS boost, (last >= 1706572800 - 30 * 86400)::INT AS band, score >= 0.25 AS recent FROM s"""
)
def recent_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", epoch().alias("at"))
    s = e.groupBy("user_id").agg(usage.decayed_count(F.col("at"), F.lit(NOW)).alias("score"), F.max("at").alias("last"))
    return s.select("user_id", F.round(usage.boost(F.col("score")), 6).alias("boost"), usage.usage_band(F.col("last"), F.lit(NOW)).alias("band"), (F.col("score") >= usage.RECENT_SCORE).alias("recent"))


_KIND = """CASE WHEN regexp_matches(path, '\\.(md)$') THEN 'Notes & text' WHEN regexp_matches(path, '\\.(pdf|xlsx)$') THEN 'PDF & Office documents' WHEN path LIKE '%.rs' THEN 'Code' WHEN path LIKE '%.json' THEN 'Data & config' WHEN path LIKE '%.html' THEN 'Web pages & styles' ELSE 'Other' END"""


@query(f"WITH {_PATHS} SELECT {_KIND} AS kind, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM paths GROUP BY 1")
def inventory_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.by_kind(paths(spark, sf_dir))


@query(
    f"WITH {_PATHS} SELECT folder, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (SELECT CASE WHEN path LIKE '/src1/%' THEN '/src1/' || split_part(path, '/', 3) ELSE '/' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) END AS folder, bytes FROM paths WHERE path LIKE '/src1/%' OR path LIKE '/src2/%') GROUP BY 1 ORDER BY n DESC, folder LIMIT 10"
)
def inventory_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.by_folder(filters.longest_root(paths(spark, sf_dir), ["/src1", "/src2"]))


@query(
    f"WITH {_PATHS} SELECT count(*) AS documents, count(*) FILTER (extraction = 1) AS extracted, count(*) FILTER (partial) AS partial, count(*) FILTER (extraction = 2) AS status_2, count(*) FILTER (extraction = 3) AS status_3, count(*) FILTER (extraction = 4) AS status_4, count(*) FILTER (extraction = 5) AS status_5, sum(bytes)::BIGINT AS bytes FROM paths"
)
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.totals(paths(spark, sf_dir))


@query(f"WITH {_PATHS} SELECT document_id, path, CASE WHEN partial AND extraction < 2 THEN 6 ELSE extraction END AS status FROM paths WHERE extraction >= 2 OR partial ORDER BY document_id LIMIT 20")
def attention_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.attention(paths(spark, sf_dir))


@query(f"WITH {_PATHS} SELECT path, modified AS modified_ns FROM paths ORDER BY modified DESC, path LIMIT 8")
def most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.most_recent(paths(spark, sf_dir).withColumnRenamed("modified", "modified_ns"))


@query(f"WITH {_PATHS} SELECT document_id, path FROM paths WHERE regexp_matches(path, '\\.(pdf|docx|doc|rtf|odt|pptx|xlsx)$') AND bytes > 1500 AND modified >= 1706572800 - 7 * 86400")
def filter_size_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = filters.parse("kind:documents size:>1.5KB modified:week")
    d = paths(spark, sf_dir)
    return d.where(filters.content_predicate(asked, F.col("path"), F.col("bytes"), F.col("modified"), NOW)).select("document_id", "path")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE epoch(o_orderdate) < 899424000 - 180 * 86400 AND o_totalprice >= 100000")
def filter_older_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """used:>180d and a size bound over orders, as of 1998-07-03; both reach the scan."""
    o = table(spark, sf_dir, "orders")
    bound = filters.midnight(899_424_000) - 180 * filters.DAY
    return o.where((F.col("o_orderdate") < F.expr(f"TIMESTAMP_NTZ'{datetime.fromtimestamp(bound, UTC):%Y-%m-%d %H:%M:%S}'")) & (F.col("o_totalprice") >= filters.parse_size(">=100KB").bytes)).select("o_orderkey", "o_totalprice")


@query(f"WITH {_PATHS} SELECT document_id FROM paths WHERE (path LIKE '/src1/%' OR path LIKE '/src2/en/%') AND NOT path LIKE '/src1/fr/%'")
def scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).where(filters.scope_predicate(F.col("path"), ["/src1", "/src2/en"], ["/src1/fr"])).select("document_id")


@query(
    r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?:/', ''), '[?#].*$', '') AS path FROM pages), p AS (SELECT DISTINCT path FROM u),
a AS (SELECT path, array_to_string(list_slice(parts, 1, n), '/') AS up FROM (SELECT path, string_split(path, '/') AS parts, unnest(range(2, len(string_split(path, '/')))) AS n FROM p))
SELECT path FROM p WHERE path NOT IN (SELECT path FROM a WHERE up IN (SELECT path FROM p))"""
)
def path_antichain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths that lie below no other page's path."""
    u = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?:/", ""), "[?#].*$", "").alias("path")).distinct()
    return filters.without_descendants(u)


@query(f"WITH {_PATHS} SELECT document_id, (extraction = 1) OR (extraction = 0 AND regexp_matches(path, '\\.(txt|md|markdown|rst|html)$')) AS semantic, (extraction = 1 AND NOT path LIKE '%.xlsx') OR (extraction = 0 AND NOT regexp_matches(path, '\\.(json|csv|tsv|xml|yaml|yml|toml)$')) AS passage FROM paths")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paths(spark, sf_dir)
    return d.select("document_id", filters.semantic_eligible(F.col("path"), F.col("extraction")).alias("semantic"), filters.passage_eligible(F.col("path"), F.col("extraction")).alias("passage"))


@query(f"WITH {_PATHS} SELECT document_id, CASE WHEN path NOT LIKE '/src1%' THEN 'outside the indexed folders' WHEN path LIKE '/src1/fr/%' THEN 'excluded by a rule' WHEN NOT regexp_matches(path, '\\.(md|pdf|rs|json|html|xlsx)$') THEN 'not a supported kind' WHEN extraction = 3 THEN 'locked' WHEN extraction = 4 THEN 'too large' WHEN extraction = 5 THEN 'unreadable' WHEN extraction = 2 THEN 'no text' ELSE 'indexed' END AS reason FROM paths")
def explain_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paths(spark, sf_dir)
    p = F.col("path")
    rows = d.withColumns({"in_scope": F.startswith(p, F.lit("/src1")), "is_excluded": filters.under(p, "/src1/fr"), "supported": filters.indexable(p), "n_passages": F.lit(1), "n_vectors": F.lit(1)})
    return inventory.explain_document(rows).select("document_id", "reason")


@query(
    """WITH e AS (SELECT user_id AS folder, epoch_us(ts) // 1000000 AS sec FROM events) SELECT folder, count(*) AS n FROM e WHERE sec > 1706572800 - 86400 AND sec <= 1706572800 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, folder LIMIT 3"""
)
def busy_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("folder"), epoch().alias("at"))
    return inventory.busy_folders(e, NOW, span=86400, least=2)


#: SQL of the letters of part names with their bonuses: 10 at a word's start, 5 at a hump, else 0.
_LETTERS = r"""c AS (SELECT id, name, i, lower(name)[i] AS c, name[i] AS now, CASE WHEN i = 1 THEN ' ' ELSE name[i - 1] END AS before FROM (SELECT p_partkey AS id, p_name AS name, unnest(range(1, length(p_name) + 1)) AS i FROM part)),
l AS (SELECT id, name, i, c, CASE WHEN regexp_matches(now, '[\p{L}\p{N}]') AND NOT regexp_matches(before, '[\p{L}\p{N}]') THEN 10 WHEN regexp_matches(now, '\p{Lu}') AND regexp_matches(before, '\p{Ll}') OR regexp_matches(now, '\p{Nd}') AND NOT regexp_matches(before, '\p{Nd}') THEN 5 ELSE 0 END AS bonus FROM c)"""


@query(
    f"""WITH {_LETTERS}, q AS (SELECT n_nationkey AS query_id, lower(n_name[1]) AS a, lower(n_name[2]) AS b FROM nation),
s AS (SELECT query_id, x.id, x.name, max(32 + 2 * x.bonus + CASE WHEN y.i = x.i + 1 THEN greatest(x.bonus, y.bonus, 4) ELSE y.bonus - 3 - (y.i - x.i - 2) END) AS score FROM q JOIN l x ON x.c = q.a JOIN l y ON y.c = q.b AND y.id = x.id AND y.i > x.i GROUP BY ALL)
SELECT query_id, id, name, score::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s QUALIFY place <= 20"""
)
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first two letters of each nation."""
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.lower(F.substring("n_name", 1, 2)).alias("text"))
    return ranking.rank_names(names, asked, 20)


@query(
    f"""WITH {_LETTERS}, q AS (SELECT r_regionkey AS query_id, lower(r_name[1]) AS a FROM region), o AS (SELECT l_partkey AS id, count(*) / 8.0::DOUBLE AS used FROM lineitem GROUP BY 1),
u AS (SELECT p_partkey AS id, greatest(coalesce(used, 0), p_size / 8.0::DOUBLE) AS used FROM part LEFT JOIN o ON o.id = p_partkey WHERE p_partkey % 3 = 0),
s AS (SELECT query_id, l.id, l.name, floor(max(16 + 2 * bonus) * (1.0::DOUBLE + 0.6::DOUBLE * max(coalesce(used, 0)) / (max(coalesce(used, 0)) + 3.0::DOUBLE)) + 0.5::DOUBLE)::BIGINT AS score FROM q JOIN l ON l.c = q.a LEFT JOIN u ON u.id = l.id GROUP BY ALL)
SELECT query_id, id, name, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s QUALIFY place <= 50"""
)
def boosted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the first letter of each region; every third part has uses, its orders or its size, whichever is more."""
    p = table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg((F.count("*") / 8.0).alias("used"))
    uses = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 8.0).alias("external")).join(orders, "id", "left")
    asked = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("query_id"), F.lower(F.substring("r_name", 1, 1)).alias("text"))
    return ranking.rank_names(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), asked, 50, uses)


@query(
    r"""WITH h AS (SELECT doc_id AS clip, doc_id % 50 = 0 AS pinned, n_chars AS front, substr(text, 1, 500) AS t FROM documents),
s AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}])q') THEN 36 WHEN regexp_matches(t, '\p{Ll}Q') THEN 26 WHEN regexp_matches(t, '(?i)q') THEN 16 END AS score FROM h)
SELECT clip, score::BIGINT AS score, row_number() OVER (ORDER BY score DESC, pinned DESC, front DESC, clip) AS place FROM s WHERE score IS NOT NULL QUALIFY place <= 50"""
)
def clip_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as clips, searched for a letter in what the search reads of a clip."""
    history = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip"), "text", (F.col("doc_id") % 50 == 0).alias("pinned"), F.col("n_chars").alias("front"))
    return ranking.search_clips(history, "q").select("clip", "score", "place")


@query(
    "SELECT p_partkey FROM part WHERE len(list_filter(string_split_regex(lower(p_name), '\\s+'), lambda w: starts_with(w, 'rin'))) > 0 OR starts_with(lower(p_name), 'rin') OR starts_with(lower(p_brand), 'rin') OR starts_with(lower(p_type), 'rin')"
)
def command_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as commands, their brands and types as keywords."""
    p = table(spark, sf_dir, "part")
    commands = p.select("p_partkey", F.col("p_name").alias("title"), F.array(F.lower("p_brand"), F.lower("p_type")).alias("keywords"))
    return ranking.matching_commands(commands, " RIN").select("p_partkey")


@query(f"WITH {_PATHS} SELECT document_id FROM paths WHERE regexp_matches(path, '\\.(txt|md|markdown|rst|html|pdf|docx|doc|rtf|odt|pptx)$') OR (NOT regexp_matches(path, '\\.(json|csv|tsv|xml|yaml|yml|toml)$') AND (path LIKE '/src1/%' OR path LIKE '/src2/en/%'))")
def eligible_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose and documents of all folders, code of two."""
    d = paths(spark, sf_dir)
    return d.where(filters.eligible_path(F.col("path"), ["/src1", "/src2/en"])).select("document_id")
