"""Converter plans: encoders, dates, arithmetic, units, hashes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import convert, text
from lodestone.plans.registry import epoch, query, table


@query(
    r"""WITH n AS (SELECT c_custkey AS id, c_name || ' ~*+/é ' || c_mktsegment AS s FROM customer)
SELECT id, sha256(s) AS sha, to_base64(encode(s)) AS b64, url_encode(s) AS pct, '0x' || lower(to_hex(id)) AS hex, '0b' || to_binary(id) AS bin, s AS back FROM n"""
)
def encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat("c_name", F.lit(" ~*+/é "), "c_mktsegment")
    n = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), s.alias("s"))
    coded = n.withColumns({"b64": convert.base64_encoded(F.col("s")), "pct": convert.percent_encoded(F.col("s"))})
    both = F.when(convert.base64_decoded(F.col("b64")) == convert.percent_decoded(F.col("pct")), convert.base64_decoded(F.col("b64")))
    return coded.select("id", convert.sha256_hex(F.col("s")).alias("sha"), "b64", "pct", convert.hex_of(F.col("id")).alias("hex"), convert.binary_of(F.col("id")).alias("bin"), both.alias("back"))


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') || ' UTC' AS utc, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch_us(ts) // 1000000 AS epoch FROM events")
def civil_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", epoch().alias("epoch"))
    literal = convert.epoch_literal(F.concat(F.lit("@"), F.col("epoch").cast("string")))
    back = convert.offset_timestamp(F.concat(F.date_format(literal, "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000")))
    return e.select("event_id", convert.utc_text(literal).alias("utc"), convert.iso_text(literal).alias("iso"), back.alias("epoch"))


@query("SELECT p_partkey, CASE WHEN (p_size * 2 + 10 - 3 * (p_partkey % 7))::BIGINT IS NULL THEN NULL ELSE (p_size * 2 + 10 - 3 * (p_partkey % 7))::VARCHAR END AS value FROM part")
def calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic written out for every part and evaluated."""
    p = table(spark, sf_dir, "part")
    expression = F.concat(F.col("p_size").cast("string"), F.lit(" * 2 + 0xA - (1 + 2)*("), F.col("p_partkey").cast("string"), F.lit(" mod 7)"))
    return p.select("p_partkey", convert.calculated(expression).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size * 1024 = 0 THEN '0' ELSE (p_size * 1024)::VARCHAR END || ' kib' AS value FROM part")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", convert.converted_units(F.concat(F.col("p_size").cast("string"), F.lit(" MiB in kib"))).alias("value"))


@query(
    """WITH h AS (SELECT page_id, list_reduce([14695981039346656037::UHUGEINT] || list_transform(range(1, length(url) + 1), lambda i: ord(url[i])::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM pages)
SELECT page_id, CASE WHEN h >= 9223372036854775808 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END::BIGINT AS id FROM h"""
)
def path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable 64-bit ids of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", convert.fnv1a_64("url").alias("id"))


@query("SELECT event_id, props::JSON->>'k' AS k, '{\"k\":' || (props::JSON->>'k') || '}' AS flat FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), convert.json_flat("props").alias("flat"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#:]+)', 1), '^www\.', '') AS host FROM pages")
def link_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.link_host(F.col("url")).alias("host"))


@query(r"SELECT conv_id, turn, substring(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 500) AS clip FROM conversations WHERE trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') <> ''")
def clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", text.flattened_clip(F.col("text")).alias("clip")).where("clip is not null")


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS tokyo FROM events")
def time_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    moved = F.convert_timezone(F.lit("UTC"), F.lit(convert.zone("tokyo")), F.col("ts"))
    return e.select("event_id", F.date_format(moved, "yyyy-MM-dd HH:mm").alias("tokyo"))
