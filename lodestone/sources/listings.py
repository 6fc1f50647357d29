"""Readers of tool output and logs: tagged lines, attribute dumps, JSON rows, JSONL history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.convert import byte_count, offset_timestamp
from lodestone.operators.catalog_state import last_n


def numbered_lines(dumps: DataFrame) -> DataFrame:
    """(source, n, line) of dumps(source, text)."""
    return dumps.select("source", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))


def sockets(dumps: DataFrame) -> DataFrame:
    """(source, pid, command, protocol, address, n) from tagged lines p, c, P and n, each carrying on what came before."""
    tag, value = F.substring("line", 1, 1), F.substring("line", 2, 1 << 20)
    rows = numbered_lines(dumps).where(F.length("line") > 0).withColumn("tag", tag).withColumn("value", value)
    so_far = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("process", F.count_if(F.col("tag") == "p").over(so_far))
    in_process = Window.partitionBy("source", "process").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    kept = lambda cond, w: F.last(F.when(cond, F.col("value")), ignorenulls=True).over(w)
    rows = rows.withColumn("pid", F.coalesce(kept(F.col("tag") == "p", so_far).try_cast("long"), F.lit(0)))
    rows = rows.withColumn("command", F.coalesce(kept(F.col("tag") == "c", in_process), F.lit("")))
    rows = rows.withColumn("protocol", F.coalesce(kept((F.col("tag") == "P") & F.col("value").isin("TCP", "UDP"), so_far), F.lit("TCP")))
    return rows.where("tag = 'n' and pid <> 0").select("source", "pid", "command", "protocol", F.col("value").alias("address"), "n")


def with_processes(listeners: DataFrame, processes: DataFrame, captured: int) -> DataFrame:
    """listeners with started and path of processes(pid, started, path) that ran when the list was captured."""
    live = processes.where(F.col("started") <= captured)
    return listeners.join(live, "pid", "left").withColumn("started", F.coalesce("started", F.lit(0)))


def console(listeners: DataFrame, query: str) -> DataFrame:
    """Rows for a console query: a port, ports, listening, localhost, a name, or 'pid|children|ports N'."""
    text = query.strip()
    word, _, rest = text.partition(" ")
    if rest:
        if word not in ("pid", "children", "ports") or not rest.strip().isdigit():
            return listeners.limit(0)
        column = "parent" if word == "children" else "pid"
        return listeners.where(F.col(column) == int(rest))
    if text in ("ports", "listening", "processes"):
        return listeners
    if text == "localhost":
        return listeners.where(F.startswith("address", F.lit("127.")) | F.startswith("address", F.lit("[::1]:")))
    if text.isdigit():
        return listeners.where(F.endswith("address", F.lit(f":{int(text)}"))) if 0 < int(text) < 65536 else listeners.limit(0)
    if text and len(text) <= 128 and all(c.isalnum() or c in "._-" for c in text):
        return listeners.where(F.contains(F.lower("command"), F.lit(text.lower())))
    return listeners.limit(0)


def used_dates(dumps: DataFrame, attribute: str = "kMDItemUsedDates") -> DataFrame:
    """(source, path, at) from a multi-line attribute dump; malformed dates are skipped, a path's last list counts."""
    rows = numbered_lines(dumps)
    head = F.startswith("line", F.lit("/"))
    so_far = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.count_if(head).over(so_far))
    block = Window.partitionBy("source", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opening = F.first("line").over(block)
    path = F.regexp_extract(opening, rf"^(/.*)   {attribute} = \s*\(\s*$", 1)
    closed = F.coalesce(F.count_if(F.trim("line") == ")").over(block), F.lit(0))
    date = offset_timestamp(F.regexp_replace(F.regexp_replace(F.trim("line"), ",+$", ""), '^"+|"+$', ""))
    found = rows.select("source", "block", path.alias("path"), closed.alias("closed"), date.alias("at")).where("path <> '' and closed = 0 and at is not null")
    newest = found.groupBy("source", "path").agg(F.max("block").alias("block"))
    return found.join(newest, ["source", "path", "block"]).select("source", "path", "at")


def container_samples(rows: DataFrame) -> DataFrame:
    """Typed samples of rows(json): cpu percent, memory and limit in bytes; malformed rows go."""
    j = F.from_json("json", "ID string, Name string, CPUPerc string, MemUsage string")
    s = rows.select(j.alias("s")).where("s.ID is not null")
    used, limit = F.split_part("s.MemUsage", F.lit("/"), F.lit(1)), F.split_part("s.MemUsage", F.lit("/"), F.lit(2))
    return s.select(F.col("s.ID").alias("id"), F.col("s.Name").alias("name"), F.regexp_replace("s.CPUPerc", "%", "").try_cast("double").alias("cpu"), byte_count(used).alias("memory"), byte_count(limit).alias("limit"))


def images(rows: DataFrame) -> DataFrame:
    """rows(id, reference, n) by id with distinct references in first-seen order."""
    seen = rows.groupBy("id", "reference").agg(F.min("n").alias("n"))
    return seen.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "reference"))), lambda x: x.reference).alias("references"))


def history(spark: SparkSession, path: str, schema: str, order: str, keep: int = 200) -> DataFrame:
    """The newest ``keep`` entries of a JSONL log, newest first; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc(order)).limit(keep)


def recent_files(files: DataFrame, now: int, noise: Column, days: int = 14, most: int = 50) -> DataFrame:
    """files(name, path, last_used) used in the last days, no noise, newest first."""
    return files.where((F.col("last_used") >= now - days * 86400) & ~noise).orderBy(F.desc("last_used"), "name").limit(most)


def apps(entries: DataFrame) -> DataFrame:
    """Catalog of entries(path, display, bundle_name, agent): first name there is; agents are left out."""
    stem = F.regexp_extract("path", r"([^/]+)\.app/?$", 1)
    return entries.where(~F.coalesce("agent", F.lit(False)) & F.col("path").rlike(r"\.app/?$")).select("path", F.coalesce(F.nullif("display", F.lit("")), F.nullif("bundle_name", F.lit("")), stem).alias("name"))


def agenda(events: DataFrame, now: int, today: int, most: int = 24) -> DataFrame:
    """events(start, end, all_day, title) of today and tomorrow that are not over; ``header`` where the day changes."""
    live = events.where((F.col("start") < today + 2 * 86400) & (F.col("end") > today) & (F.col("end") > now)).orderBy("start", "all_day", "title").limit(most)
    day = F.floor((F.col("start") - today) / 86400)
    w = Window.orderBy("start", "all_day", "title")
    return live.withColumn("header", ~F.lag(day).over(w).eqNullSafe(day))


MEETING_HOSTS = "zoom.us meet.google.com teams.microsoft.com teams.live.com webex.com whereby.com".split()


def meeting_link(text: Column) -> Column:
    """The first link to a meeting host, as https; null without one."""
    links = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"]+"), F.lit(0))
    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/?#:]+)", 1))
    ours = lambda u: F.exists(F.array(*map(F.lit, MEETING_HOSTS)), lambda h: (host(u) == h) | F.endswith(host(u), F.concat(F.lit("."), h)))
    return F.regexp_replace(F.get(F.filter(links, ours), F.lit(0)), "^http:", "https:")


def container_order(containers: DataFrame, most: int = 2000) -> DataFrame:
    """Running first, then by name."""
    return containers.orderBy(F.desc("running"), "name", "id").limit(most)


def recent_samples(samples: DataFrame, keep: int = 120) -> DataFrame:
    return last_n(samples, "id", "t", keep)
