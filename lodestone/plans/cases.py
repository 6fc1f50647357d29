"""Plans of small operators: path rules, converters, launcher lists, catalog upkeep, index upkeep.

Each runs over a whole table of the driver; where the tables have nothing of the kind, its texts are made of their columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import chunking, convert, text, vectors
from lodestone.operators import catalog_state as state
from lodestone.operators import filters, inventory, lexical, ranking
from lodestone.plans.ranking import _PATHS, NOW, paths
from lodestone.plans.registry import epoch, query, table
from lodestone.sources import files, listings
from lodestone.streaming.state import flush_delay, needs_full_scan, retry_delay


def stated(columns: str, values: str) -> str:
    """SQL of a few rows, the same in both dialects."""
    return f"SELECT * FROM (VALUES {values}) AS t({columns})"


# --- path rules -------------------------------------------------------------------------------------

_PLACES = ["Users/a", "System", "Users/a/Library/x", "opt/tool", "Users/a/.cache", "Users/a/node_modules", "Users/a/My.app/Contents", "Users/a/go/pkg/mod", "Volumes/d", "Users/a/build", "Users/a/secrets", "Users/a/venv"]
_NAMES = ["notes.md", "main.rs", "id_rsa", ".env", "photo.png", "key.pem", "Deck.PPTX", "README", "a.tar.gz", "secret.txt", "page.html", "b.framework"]
_WALK = f"""walk AS (SELECT doc_id, '/' || [{", ".join(f"'{p}'" for p in _PLACES)}][1 + doc_id % 12] || '/' || source || '/' || [{", ".join(f"'{p}'" for p in _NAMES)}][1 + (doc_id // 12) % 12] AS path FROM documents)"""


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up path for every document."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i % 12 + 1).cast("int"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("/"), pick(_PLACES, F.col("doc_id")), F.lit("/"), "source", F.lit("/"), pick(_NAMES, F.floor(F.col("doc_id") / 12))).alias("path"))


@query(
    rf"""WITH {_WALK} SELECT doc_id, regexp_matches(path, '^/(System|usr|private|opt|bin|sbin|cores|dev)/') OR contains(path, '/go/pkg/')
OR regexp_matches(path, '/(Library|node_modules|DerivedData|__pycache__|Pods|target|venv|site-packages|_deps|vendor|bower_components)(/|$)') OR regexp_matches(path, '/(\.[^/]*|[^/]*\.(app|framework|bundle|plugin|appex|xpc))/') AS noise FROM walk"""
)
def noise_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk(spark, sf_dir).select("doc_id", ranking.is_noise(F.col("path")).alias("noise"))


@query(
    rf"""WITH {_WALK} SELECT doc_id, regexp_matches(path, '/\.') OR regexp_matches(path, '/(node_modules|DerivedData|__pycache__|Pods|target|venv|site-packages|_deps|vendor|bower_components|build|dist)(/|$)')
OR regexp_matches(path, '\.(app|framework|bundle|plugin|appex|xpc)(/|$)') OR regexp_matches(path, '(?i)/((id_rsa|id_dsa|id_ecdsa|id_ed25519|credentials|secrets?)(\.[^/]*)?|[^/]*\.(pem|key|p12|pfx|keychain|kdbx))$') AS excluded,
regexp_matches(path, '(?i)/[^/]+\.(txt|md|markdown|rst|json|toml|yaml|yml|csv|tsv|xml|html|css|rs|swift|py|js|jsx|ts|tsx|go|java|c|h|cpp|hpp|rb|sh|sql|pdf|docx|doc|rtf|odt|pptx|xlsx)$') AS indexable FROM walk"""
)
def indexable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return walk(spark, sf_dir).select("doc_id", filters.excluded(p).alias("excluded"), filters.indexable(p).alias("indexable"))


@query(f"WITH {_PATHS} SELECT document_id FROM paths WHERE NOT (path >= '/src1/en/' AND path < '/src1/en0')")
def range_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after all below a folder went, by its key range."""
    return paths(spark, sf_dir).where(~filters.under(F.col("path"), "/src1/en")).select("document_id")


@query(f"WITH {_PATHS} SELECT document_id, path FROM paths WHERE path LIKE '/src3/%' AND path NOT LIKE '/src3/%/%/%' AND document_id > 5 AND (extraction >= 2 OR partial) ORDER BY document_id LIMIT 128")
def retry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.retry_set(paths(spark, sf_dir).where(filters.under(F.col("path"), "/src3")), after=5).select("document_id", "path")


@query("SELECT '/h/' || p_name AS path FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL ORDER BY path LIMIT 4096")
def home_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a home folder: parts are files in it, in a subfolder, or hidden."""
    p = table(spark, sf_dir, "part")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/h/"), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("/h/sub/"), "p_name")).otherwise(F.concat(F.lit("/h/."), "p_name"))
    return files.home_entries(p.select(path.alias("path")).distinct(), "/h/").select("path")


@query(f"WITH {_PATHS} SELECT document_id, CASE WHEN path LIKE '%.xlsx' AND extraction = 1 THEN 'sections' WHEN path LIKE '%.pdf' AND extraction = 1 THEN 'paged' WHEN path LIKE '%.rs' THEN 'code' ELSE 'prose' END AS kind FROM paths")
def chunk_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paths(spark, sf_dir)
    return d.select("document_id", chunking.kind_of(F.col("path"), F.col("extraction") == 1).alias("kind"))


_SAID = """CASE p_partkey % 6 WHEN 0 THEN 'kind:PDF ' || p_name WHEN 1 THEN 'size:>=' || p_size || 'KB ' || p_name WHEN 2 THEN p_name || ' modified:' || p_size || 'd'
WHEN 3 THEN '"kind:pdf" ' || p_name WHEN 4 THEN 'used:>' || p_size || 'd size:<' || p_size || '.5MiB ' || p_name ELSE 'modified:week size:' || p_size || ' other:x' END"""


@query(
    f"""SELECT p_partkey, {_SAID} AS said, CASE WHEN p_partkey % 6 = 0 THEN 'pdf' END AS kind,
CASE p_partkey % 6 WHEN 1 THEN '>=' WHEN 4 THEN '<' WHEN 5 THEN '=' END AS sign, CASE p_partkey % 6 WHEN 1 THEN p_size * 1000 WHEN 4 THEN p_size * 1048576 + 524288 WHEN 5 THEN p_size END::BIGINT AS bytes,
CASE p_partkey % 6 WHEN 2 THEN 'modified within ' || p_size WHEN 4 THEN 'used older ' || p_size WHEN 5 THEN 'modified within 7' END AS age,
CASE p_partkey % 6 WHEN 3 THEN 'kind:pdf ' || p_name WHEN 5 THEN 'other:x' ELSE p_name END AS name FROM part"""
)
def typed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries typed about parts, taken apart."""

    def run(frames):
        for f in frames:
            got = [filters.parse(q) for q in f["said"]]
            age = lambda p: next((f"{n} {a.kind} {a.days}" for n, a in (("modified", p.modified), ("used", p.used)) if a), None)
            yield f.assign(kind=[p.kind for p in got], sign=[p.size and p.size.comparison for p in got], bytes=pd.array([p.size.bytes if p.size else None for p in got], "Int64"), age=[age(p) for p in got], name=[p.name for p in got])

    said = table(spark, sf_dir, "part").select("p_partkey", F.expr(_SAID).alias("said"))
    return said.mapInPandas(run, "p_partkey long, said string, kind string, sign string, bytes long, age string, name string")


# --- text -------------------------------------------------------------------------------------------


@query(r"SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS terms FROM benchmark WHERE len(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) <= 32 AND NOT regexp_matches(text, '[^\x00-\x7F]')".replace("list_distinct(", "list_sort(list_distinct(").replace("w <> '')) AS", "w <> ''))) AS"))
def required_term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict terms of the short plain benchmark texts."""
    b = table(spark, sf_dir, "benchmark").where(~F.col("text").rlike(r"[^\x00-\x7F]") & (F.size(text.tokens(F.col("text"))) <= 32))
    return b.select("item_id", F.array_sort(text.required_terms(F.col("text"))).alias("terms"))


@query("SELECT doc_id, substring(coalesce(lang, ''), 1, 256) || chr(10) || substring(text, 1, 4096) AS input, p_title || CASE WHEN doc_id % 5 = 0 THEN ' · slide 3' WHEN doc_id % 5 = 1 THEN ' · p. 3' WHEN doc_id % 5 = 2 THEN ' · line 9' ELSE '' END AS citation FROM (SELECT *, 'doc ' || doc_id AS p_title FROM documents)")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an embedding model is given, and how a passage is cited: slide, page, line or title alone."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 5
    cited = text.citation(F.concat(F.lit("doc "), "doc_id"), F.when(k == 0, "pptx").otherwise("pdf"), F.when(k <= 1, 3).otherwise(0), F.when(k == 2, 9).otherwise(1))
    return d.select("doc_id", text.embedding_input(F.coalesce("lang", F.lit("")), F.col("text")).alias("input"), cited.alias("citation"))


@query(r"SELECT conv_id, turn, regexp_replace('x' || chr(27) || '[31m' || text || chr(7), '\x1B\[[0-?]*[ -/]*[@-~]|[\x00-\x08\x0B-\x1F\x7F]', '', 'g') AS plain FROM conversations")
def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured log lines without escapes and control characters."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.without_controls(F.concat(F.lit("x\x1b[31m"), "text", F.lit("\x07"))).alias("plain"))


@query("SELECT c_custkey AS id, regexp_matches(k, '^[a-z0-9_-]{1,32}$') AS keyword, strlen(u) <= 2048 AND regexp_matches(u, '^https?://[^ ]+$') AS link FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS k, CASE c_custkey % 3 WHEN 0 THEN 'https://a.example/' || c_custkey WHEN 1 THEN 'ftp://a' ELSE 'http://a b' END AS u FROM customer)")
def link_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    keyword = F.when(n % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    link = F.when(n % 3 == 0, F.concat(F.lit("https://a.example/"), n)).when(n % 3 == 1, "ftp://a").otherwise("http://a b")
    return c.select(n.alias("id"), text.valid_keyword(keyword).alias("keyword"), text.valid_link(link).alias("link"))


_ASKED = """CASE o_orderkey % 4 WHEN 0 THEN 'Any meeting' WHEN 1 THEN 'any meeting notes' WHEN 2 THEN '>agenda' ELSE 'an invoice' END || CASE o_custkey % 3 WHEN 0 THEN ' today?' WHEN 1 THEN ' next week' ELSE '' END"""


@query(f"SELECT o_orderkey, {_ASKED} AS said, o_orderkey % 4 = 0 OR (o_orderkey % 4 = 2 AND o_custkey % 3 <> 2) AS calendar, o_orderpriority IN ('1-URGENT', '5-LOW') OR o_orderstatus = 'P' AS private FROM orders")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about the calendar; clips whose types hold a marker."""
    t = table(spark, sf_dir, "orders").withColumn("said", F.expr(_ASKED))
    marks = F.array("o_orderpriority", "o_orderstatus")
    return t.select("o_orderkey", "said", text.asks_about_calendar(F.col("said")).alias("calendar"), text.is_private_clip(marks, ["1-URGENT", "5-LOW", "P"]).alias("private"))


@query(r"SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(head, '([.!?])', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS sentences FROM (SELECT doc_id, trim(substring(regexp_replace(text, '\s+', ' ', 'g'), 1, 120)) AS head FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x7F]'))")
def sentence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents' openings, packed to one each."""
    d = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    head = F.trim(F.substring(F.regexp_replace("text", r"\s+", " "), 1, 120))

    def run(frames):
        for f in frames:
            yield f[["doc_id"]].assign(sentences=[chunking.sentence_passages(t, 1, 1000) for t in f["head"]])

    return d.select("doc_id", head.alias("head")).mapInPandas(run, "doc_id long, sentences array<string>")


@query(r"SELECT p_partkey, 1 + p_partkey % 7 AS marks, CASE WHEN 1 + p_partkey % 7 <= 6 THEN 1 + p_partkey % 7 ELSE 0 END AS level, lower(split_part(p_name, ' ', 1)) || ' ' || lower(split_part(p_name, ' ', 2)) AS words FROM part WHERE p_name LIKE '% %'")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of one to seven marks, and identifiers made of parts' names."""
    p = table(spark, sf_dir, "part").where(F.contains("p_name", F.lit(" ")))

    def run(frames):
        for f in frames:
            heads = [chunking.heading_level("#" * int(m) + " x") for m in f["marks"]]
            words = [" ".join(w.lower() for w in chunking.split_identifier(a.lower() + b.capitalize())) for a, b in zip(f["a"], f["b"])]
            yield f[["p_partkey", "marks"]].assign(level=heads, words=words)

    rows = p.select("p_partkey", (1 + F.col("p_partkey") % 7).alias("marks"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"))
    return rows.mapInPandas(run, "p_partkey long, marks long, level long, words string")


# --- converters -------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, 'https://s.example/?q=' || url_encode(c_name || ' &é') AS link, '[\"' || c_mktsegment || '\",' || c_nationkey || ',384]' AS model, CASE WHEN c_custkey % 2 = 0 THEN 'http://a/' || c_custkey END AS url FROM customer")
def link_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quick links filled in, model keys, and texts that are one link."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey")
    lone = F.when(n % 2 == 0, F.concat(F.lit(" http://a/"), n, F.lit(" "))).otherwise(F.lit("see http://a"))
    return c.select(n.alias("id"), convert.expanded_link(F.lit("https://s.example/?q={query}"), F.concat("c_name", F.lit(" &é"))).alias("link"), convert.model_key(F.col("c_mktsegment"), F.col("c_nationkey"), F.lit(384)).alias("model"), convert.lone_url(lone).alias("url"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1024.0 WHEN 1 THEN p_size * 1000.0 WHEN 2 THEN p_size * 1073741824.0 WHEN 3 THEN p_size::DOUBLE END::DOUBLE AS bytes FROM part")
def byte_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    unit = F.when(k == 0, "KiB").when(k == 1, "kB").when(k == 2, "GiB").when(k == 3, "B").otherwise("parsecs")
    return p.select("p_partkey", convert.byte_count(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


_HOUR = "(user_id % 30)"
_CLOCK = f"""CASE event_id % 5 WHEN 0 THEN {_HOUR} || ':' || lpad(CAST(event_id % 70 AS STRING), 2, '0') WHEN 1 THEN {_HOUR} || CASE WHEN event_id % 2 = 0 THEN ' PM' ELSE 'am' END
WHEN 2 THEN {_HOUR} || 'h' || lpad(CAST(event_id % 60 AS STRING), 2, '0') WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 'Noon' ELSE ' midnight ' END ELSE CAST({_HOUR} AS STRING) END"""


@query(
    f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN {_HOUR} < 24 AND event_id % 70 < 60 THEN {_HOUR} * 60 + event_id % 70 END
WHEN 1 THEN CASE WHEN {_HOUR} BETWEEN 1 AND 12 THEN {_HOUR} % 12 * 60 + CASE WHEN event_id % 2 = 0 THEN 720 ELSE 0 END END
WHEN 2 THEN CASE WHEN {_HOUR} < 24 THEN {_HOUR} * 60 + event_id % 60 END WHEN 3 THEN CASE WHEN event_id % 2 = 0 THEN 720 ELSE 0 END END::INT AS minute FROM events"""
)
def clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day, written in five ways, as minutes."""

    def run(frames):
        for f in frames:
            read = [convert.clock(s) for s in f["said"]]
            yield f[["event_id"]].assign(minute=pd.array([t and t[0] * 60 + t[1] for t in read], "Int32"))

    return table(spark, sf_dir, "events").select("event_id", F.expr(_CLOCK).alias("said")).mapInPandas(run, "event_id long, minute int")


@query("SELECT event_id, least(900.0, 30.0 * pow(2, least(user_id % 9, 5)))::DOUBLE AS retry, greatest(2.0, 10.0 - event_id % 12)::DOUBLE AS flush, user_id % 200 > 128 OR event_id % 97 = 0 AS whole FROM events")
def delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backoff of a failed pass, delay of collected events, and whether a full scan is due, with numbers of the events."""

    def run(frames):
        for f in frames:
            rows = list(zip(f["attempt"], f["since"], f["paths"], f["dropped"]))
            yield f[["event_id"]].assign(retry=[retry_delay(a) for a, *_ in rows], flush=[flush_delay(s) for _, s, *_ in rows], whole=[bool(needs_full_scan(p, d)) for *_, p, d in rows])

    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id % 9 AS attempt", "event_id % 12 AS since", "user_id % 200 AS paths", "event_id % 97 = 0 AS dropped")
    return e.mapInPandas(run, "event_id long, retry double, flush double, whole boolean")


# --- launcher lists ---------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 's') THEN 0 WHEN contains(lower(p_brand), 's') THEN 1 WHEN contains(lower(p_name), 's') OR contains(lower(p_type), 's') THEN 2 END AS place, contains(lower(p_name || ' ' || p_type), 'red') AND contains(lower(p_name || ' ' || p_type), 'e') AS every FROM part")
def snippet_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring places of snippets, and settings that hold every word."""
    p = table(spark, sf_dir, "part")
    place = ranking.substring_rank(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(" S "))
    return p.select("p_partkey", place.alias("place"), ranking.all_words_in(F.lit("Red  e"), F.col("p_name"), F.col("p_type")).alias("every"))


@query(
    """WITH f AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY epoch(o_orderdate) DESC, o_orderkey) AS position FROM orders),
a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer)
SELECT id, 'file' AS kind, position FROM f WHERE position <= 4 UNION ALL SELECT id, 'app', position FROM a WHERE position <= 5"""
)
def welcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as apps by balance, orders as files by date."""
    apps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("used_score"))
    recent = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_used"))
    return ranking.welcome(apps, recent, 9).select("id", "kind", F.col("position").cast("long").alias("position"))


@query("SELECT n_name AS name FROM nation WHERE starts_with(lower(n_name), 'na')")
def command_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.completions(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "Na").select("name")


@query(
    """WITH u AS (SELECT c_nationkey AS id, max(c_custkey) AS used FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1 ORDER BY used DESC, id LIMIT 32)
SELECT n_nationkey AS id, row_number() OVER (ORDER BY used DESC NULLS LAST, n_nationkey) AS place FROM nation LEFT JOIN u ON n_nationkey = id"""
)
def command_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as commands, customers as their uses."""
    commands = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("offset"))
    used = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("at"))
    ordered = ranking.by_recency(commands, used)
    return ordered.selectExpr("id", "row_number() over (order by at desc nulls last, offset) as place").select("id", F.col("place").cast("long").alias("place"))


_TODAY = 1_705_276_800  # midnight of a day in the middle of the events


@query(
    f"""WITH e AS (SELECT event_id AS id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + user_id * 60 AS e, event_id % 50 = 0 AS d, event_type || ' ' || event_id AS t FROM events),
l AS (SELECT * FROM e WHERE s < {_TODAY} + 172800 AND e > {_TODAY} AND e > {_TODAY} + 36000 ORDER BY s, d, t LIMIT 24)
SELECT id, (s - {_TODAY} < 0) IS DISTINCT FROM lag(s - {_TODAY} < 0) OVER w OR floor((s - {_TODAY}) / 86400.0) IS DISTINCT FROM lag(floor((s - {_TODAY}) / 86400.0)) OVER w AS header FROM l WINDOW w AS (ORDER BY s, d, t)"""
)
def agenda_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as meetings of a length by their user, seen at ten in the morning."""
    start = epoch()
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), start.alias("start"), (start + F.col("user_id") * 60).alias("end"), (F.col("event_id") % 50 == 0).alias("all_day"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("title"))
    return listings.agenda(e, _TODAY + 36000, _TODAY).select("id", "header")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://us02.zoom.us/j/' || page_id WHEN 1 THEN 'https://meet.google.com/' || page_id END AS link FROM pages")
def meeting_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 4
    said = F.when(k == 0, F.concat(F.lit("join http://x.example then http://us02.zoom.us/j/"), "page_id", F.lit(" now"))).when(k == 1, F.concat(F.lit("<https://meet.google.com/"), "page_id", F.lit(">"))).when(k == 2, "https://notzoom.us/j/1").otherwise("no link")
    return p.select("page_id", listings.meeting_link(said).alias("link"))


@query("WITH s AS (SELECT ps AS id, reference, min(n) AS n FROM (SELECT l_suppkey AS ps, l_returnflag AS reference, l_orderkey * 10 + l_linenumber AS n FROM lineitem) GROUP BY ALL) SELECT id, list(reference ORDER BY n, reference) AS refs FROM s GROUP BY id")
def image_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as images, return flags as their references in first-seen order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("reference"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    return listings.images(rows).select("id", F.col("references").alias("refs"))


@query(f"WITH {_PATHS} SELECT document_id FROM paths WHERE modified >= 1706572800 - 14 * 86400 AND NOT path LIKE '/src2/%' ORDER BY modified DESC, document_id LIMIT 50")
def recent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = paths(spark, sf_dir).select("document_id", F.lpad(F.col("document_id").cast("string"), 12, "0").alias("name"), "path", F.col("modified").alias("last_used"))
    return listings.recent_files(d, NOW, F.startswith("path", F.lit("/src2/"))).select("document_id")


_BUNDLE = """SELECT '/a/' || s_name || CASE WHEN s_suppkey % 5 = 0 THEN '.txt' WHEN s_suppkey % 3 = 0 THEN '.app/' ELSE '.app' END AS path, CASE WHEN s_suppkey % 4 > 0 THEN 'Shown ' || s_suppkey ELSE '' END AS display,
CASE WHEN s_suppkey % 8 > 0 THEN 'Bundle ' || s_suppkey ELSE '' END AS bundle_name, CASE WHEN s_suppkey % 7 > 1 THEN false WHEN s_suppkey % 7 = 0 THEN true END AS agent FROM"""


@query(f"WITH t AS ({_BUNDLE} supplier) SELECT path, coalesce(nullif(display, ''), nullif(bundle_name, ''), regexp_extract(path, '([^/]+)[.]app', 1)) AS name FROM t WHERE agent IS NOT TRUE AND path LIKE '%.app%'")
def app_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as bundles: some agents, some files of another kind, some without one name or both."""
    return listings.apps(spark.sql(f"{_BUNDLE} {{t}}", t=table(spark, sf_dir, "supplier")))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name, (c_custkey % 100)::DOUBLE AS cpu, c_custkey * 1024.0::DOUBLE AS memory, 2e9::DOUBLE AS lim FROM customer WHERE c_custkey % 10 <> 3")
def container_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as container statistics and read again; each tenth row is broken."""
    c = table(spark, sf_dir, "customer")
    row = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("ID"), F.col("c_name").alias("Name"), F.concat(F.col("c_custkey") % 100, F.lit(".00%")).alias("CPUPerc"), F.concat(F.col("c_custkey"), F.lit("KiB / 2GB")).alias("MemUsage")))
    return listings.container_samples(c.select(F.when(F.col("c_custkey") % 10 == 3, "{broken").otherwise(row).alias("json"))).withColumnRenamed("limit", "lim")


@query("SELECT s_suppkey AS pid, CASE WHEN s_suppkey % 2 = 0 THEN 100 ELSE 0 END AS started, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS path FROM supplier WHERE s_suppkey % 4 <> 1")
def listener_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local listeners with the processes that ran when they were listed."""
    s, n = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    listeners = s.select(n.alias("pid"), F.lit("x").alias("command"), F.when(n % 4 == 1, "*:80").otherwise("127.0.0.1:90").alias("address"))
    processes = s.select(n.alias("pid"), F.when(n % 2 == 0, 100).otherwise(999).alias("started"), F.col("s_name").alias("path"))
    return listings.with_processes(listings.console(listeners, "localhost"), processes, 500).select("pid", "started", "path")


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal > 0 DESC, s_name, s_suppkey) AS place FROM supplier QUALIFY place <= 2000")
def container_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("running"))
    placed = listings.container_order(s)
    return placed.selectExpr("id", "row_number() over (order by running desc, name, id) as place").select("id", F.col("place").cast("long").alias("place"))


# --- catalog upkeep ---------------------------------------------------------------------------------


@query("SELECT o_orderkey AS identity FROM orders WHERE o_orderkey % 4 <> 0")
def unchanged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan that found another size for each fourth file."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("identity"), F.col("o_orderdate").alias("modified_ns"), F.col("o_totalprice").alias("bytes"))
    again = o.withColumn("bytes", F.when(F.col("identity") % 4 == 0, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return state.unchanged(o, again, ("identity", "modified_ns", "bytes")).select("identity")


@query("SELECT c_custkey AS identity, CASE WHEN c_custkey % 5 = 0 THEN 3 ELSE 0 END AS extraction, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS body FROM customer")
def extraction_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fifth extraction fails; a body that was there stays."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("identity"), F.lit(0).alias("extraction"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("body"))
    return state.extraction_failed(c, c.where("identity % 5 = 0").select("identity", F.lit(3).alias("code"))).select("identity", "extraction", "body")


@query("SELECT n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE 'A%'")
def retained_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files of regions; only regions on A stay."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("root"))
    return state.retain_roots(n, table(spark, sf_dir, "region").where("r_name like 'A%'").select(F.col("r_regionkey").alias("root"))).select("id")


@query(
    """WITH h AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0), k AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F')
SELECT id, 'prune' AS side FROM h WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT id, 'missing' FROM k WHERE id NOT IN (SELECT id FROM h)"""
)
def keep_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in credit as what is held, those with a finished order as what is to be kept."""
    held = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return state.keep_differences(held, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


@query("SELECT l_orderkey AS document_id, l_linenumber AS revision, l_linenumber = 1 + l_orderkey % 3 AS current FROM lineitem")
def fenced_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late results: lines of an order as its revisions, one of which is current."""
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("int").alias("revision"))
    now = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), (1 + F.col("o_orderkey") % 3).cast("int").alias("revision"))
    current, stale = state.fenced(results, now)
    return current.withColumn("current", F.lit(True)).unionByName(stale.withColumn("current", F.lit(False)))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) GROUP BY 1")
def cascaded_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is still there after the small orders went."""
    parents = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return state.children(parents, table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


_MODELS = "('m0', true), ('m1', false), ('m2', false)"


@query(
    f"""WITH m AS ({stated("model, active", _MODELS)}), v AS (SELECT 'm' || vec_id % 3 AS model, len(embedding) AS bytes FROM embeddings)
SELECT m.model, m.model = 'm2' AS active, m.active AS kept, (SELECT count(*) FROM v WHERE v.model <> 'm2') AS retired, (SELECT coalesce(sum(bytes), 0)::BIGINT FROM v WHERE v.model <> 'm2') AS bytes, (SELECT count(*) FROM v WHERE v.model = 'm2') AS left_rows FROM m"""
)
def model_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model is activated; a pass with stale vectors changes nothing; other models' vectors are retired and compacted away."""
    models = spark.sql(stated("model, active", _MODELS))
    v = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("vec_id") % 3).alias("model"), F.col("embedding").alias("vector"))
    now = state.activate_model(models, "m2", 0, 10)
    kept = state.activate_model(models, "m1", 3, 10).select("model", F.col("active").alias("kept"))
    retired = state.retired_bytes(v, now).select(F.col("vectors").alias("retired"), F.col("bytes").cast("long").alias("bytes"))
    return now.join(kept, "model").crossJoin(retired).crossJoin(state.compacted(v, now).agg(F.count("*").alias("left_rows")))


# --- index upkeep -----------------------------------------------------------------------------------


@query("SELECT l_returnflag AS term, least(count(*), 50) AS df FROM lineitem GROUP BY 1")
def bounded_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.bounded_frequency(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("term")), 50)


@query("SELECT vec_id AS id, ((vec_id - 1) // 64) * 64 AS after_key FROM embeddings WHERE vec_id >= 1 AND ((vec_id - 1) // 64) % 2 = 0")
def shard_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of every second shard of 64 keys."""
    v = table(spark, sf_dir, "embeddings").where("vec_id >= 1").select(F.col("vec_id").alias("id"))
    shards = v.select((F.floor((F.col("id") - 1) / 64) * 64).alias("after_key")).distinct().where("(after_key / 64) % 2 = 0")
    return inventory.shard_rows(v, shards, 64).select("id", "after_key")


_LANES = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'lexical' ELSE 'fused' END AS lane, CASE WHEN o_custkey % 2 = 0 THEN 'words' ELSE 'meaning' END AS kind, CASE WHEN o_orderkey % 10 < 6 + o_orderkey % 2 * (1 + o_custkey % 2) THEN 1.0 ELSE 0.0 END AS hit FROM"""


@query(
    f"""WITH r AS ({_LANES} orders), m AS (SELECT lane, kind, round(avg(hit), 9) AS hit_5 FROM r GROUP BY ALL UNION ALL SELECT lane, 'all', round(avg(hit), 9) FROM r GROUP BY ALL)
SELECT bool_and(f.hit_5 >= l.hit_5 AND (f.kind <> 'meaning' OR f.hit_5 > l.hit_5)) AS passes, count(*) AS kinds FROM m f JOIN m l ON f.kind = l.kind AND f.lane = 'fused' AND l.lane = 'lexical'"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hits of two lanes, measured by kind and in all, then put to the gate."""
    r = spark.sql(f"{_LANES} {{t}}", t=table(spark, sf_dir, "orders"))
    m = r.unionByName(r.withColumn("kind", F.lit("all"))).groupBy("lane", "kind").agg(F.round(F.avg("hit"), 9).alias("hit_5"))
    return inventory.passes_gate(m).join(m.agg(F.countDistinct("kind").alias("kinds")))


@query(
    """WITH e AS (SELECT l_orderkey AS q, l_partkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem), f AS (SELECT q, id, p FROM e WHERE (q + p) % 3 <> 0),
w AS (SELECT q, count(DISTINCT id) AS want FROM e WHERE p <= 3 GROUP BY 1), g AS (SELECT e.q, count(DISTINCT e.id) AS got FROM e JOIN f ON e.q = f.q AND e.id = f.id AND e.p <= 3 AND f.p <= 3 GROUP BY 1)
SELECT round(avg(coalesce(got, 0) / want), 9) AS recall FROM w LEFT JOIN g USING (q)"""
)
def recall_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its exact list, a part of them as the found one."""
    exact = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS query_id", "l_partkey AS id", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position")
    return inventory.recall_at(exact.where("(query_id + position) % 3 <> 0"), exact, 3).select(F.round("recall", 9).alias("recall"))


@query("SELECT o_custkey AS query_id, min(CASE WHEN o_orderstatus = 'O' THEN p END) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1")
def first_rank_of_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as hits, the open ones as expected."""
    hits = table(spark, sf_dir, "orders").selectExpr("o_custkey AS query_id", "cast(o_orderkey AS string) AS path", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position", "o_orderstatus AS status")
    expected = hits.select("query_id", F.when(F.col("status") == "O", F.col("path")).otherwise(F.lit("none")).alias("path"))
    return inventory.first_ranks(hits, expected).select("query_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT sum(l_quantity)::DOUBLE AS indexed, sum(l_linenumber)::BIGINT AS skipped, count(*) AS failed, bool_or(l_discount > 0.09) AS interrupted FROM lineitem")
def progress_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("indexed"), F.col("l_linenumber").cast("long").alias("skipped"), F.lit(1).cast("long").alias("failed"), (F.col("l_discount") > 0.09).alias("interrupted"))
    return inventory.merged_progress(rows)


@query(f"WITH {_PATHS} SELECT '/' || split_part(path, '/', 2) AS folder, sum(bytes)::BIGINT AS bytes, (SELECT count(*) FROM paths) AS clips FROM paths GROUP BY 1")
def storage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes by top folder, and the number of clips if each file were one."""
    d = paths(spark, sf_dir)
    return inventory.storage_bytes(d).crossJoin(inventory.clip_stats(d.select("bytes")).select("clips"))


@query(
    """WITH u AS (SELECT vec_id AS id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS len, embedding FROM embeddings)
SELECT id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / len)), 6) AS total, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / 127.0, 9) AS step FROM u WHERE len > 0"""
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of unit vectors and steps of their byte form."""
    v = table(spark, sf_dir, "embeddings")
    total = F.aggregate(vectors.unit(F.col("embedding")), F.lit(0.0), lambda a, x: a + x)
    return v.where(vectors.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), F.round(total, 6).alias("total"), F.round(vectors.scale_of(F.col("embedding")), 9).alias("step"))
