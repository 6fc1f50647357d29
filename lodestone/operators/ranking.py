"""Ranking of names and paths: fuzzy score, match tiers, the lexicographic key, launcher lanes."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import scratch
from lodestone.functions import fuzzy
from lodestone.functions.fuzzy import BOUNDARY, CAMEL, CONSECUTIVE, FIRST_BONUS, GAP_MORE, GAP_START, MATCH
from lodestone.functions.usage import boost

FUZZY, SUBSTRING, WORD_START, PREFIX, EXACT = 1, 2, 3, 4, 5
NOISE, ELSEWHERE, YOURS = 0, 1, 2
#: Folder names that mark a path as noise (fixed values).
TOOLING = "node_modules DerivedData __pycache__ Pods target venv site-packages _deps vendor bower_components".split()
SYSTEM_ROOTS = "System usr private opt bin sbin cores dev".split()
CONTAINERS = ".app .framework .bundle .plugin .appex .xpc".split()


def tier(name: Column, query: Column) -> Column:
    """5 exact (also without extension), 4 prefix, 3 start of a word, 2 substring, 1 otherwise."""
    n, q = F.lower(name), F.lower(F.trim(query))
    stem = F.regexp_replace(n, r"\.[^.]*$", "")
    starts = F.exists(F.split(n, r"[^\p{L}\p{N}]"), lambda w: F.startswith(w, q))
    return F.when(q == "", FUZZY).when((n == q) | (stem == q), EXACT).when(F.startswith(n, q), PREFIX).when(starts, WORD_START).when(F.contains(n, q), SUBSTRING).otherwise(FUZZY)


def is_noise(path: Column) -> Column:
    """System files, caches, tooling, hidden folders and the inside of bundles."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    inside = F.exists(folders, lambda p: p.startswith(".") | F.exists(F.array(*map(F.lit, CONTAINERS)), lambda c: F.endswith(p, c)))
    module_cache = F.contains(F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/")), F.lit("/go/pkg/"))
    return F.coalesce(F.get(parts, F.lit(0)).isin(SYSTEM_ROOTS), F.lit(False)) | module_cache | F.exists(parts, lambda p: p.isin("Library", *TOOLING)) | inside


def key(name: Column, path: Column, is_app: Column, used: Column, fuzzy: Column, query: Column, home: str) -> Column:
    """One struct whose descending order is the ranking."""
    base = home.rstrip("/") + "/"
    under_home = path.startswith(base)
    rest = F.when(under_home, F.substring(path, len(base) + 1, 1 << 20))
    depth = F.size(F.filter(F.split(F.coalesce(rest, F.concat(F.lit("/"), path)), "/"), lambda p: p != "")) + F.when(under_home, 0).otherwise(1)
    noise = ~is_app & is_noise(path)
    place = F.when(is_app, YOURS).when(noise, NOISE).when(under_home | path.startswith("/Volumes/"), YOURS).otherwise(ELSEWHERE)
    t = tier(name, query)
    return F.struct(
        place.alias("place"),
        (t >= WORD_START).alias("strong"),
        used.alias("used"),
        (is_app | F.coalesce(under_home & (depth == 1), F.lit(False))).alias("top_level"),
        t.alias("tier"),
        (~is_app & ~noise & under_home).alias("user_file"),
        (-F.when(is_app, 0).otherwise(depth)).alias("depth"),
        (-F.char_length(name)).alias("length"),
        fuzzy.alias("fuzzy"),
    )


def fuzzy_match(query: str, name: str) -> tuple[int, list[int]] | None:
    """(score, positions) of the best subsequence match; None if the query is no subsequence.

    An affine-gap alignment: 16 a character, a bonus at word starts (doubled for the first character)
    that consecutive characters inherit. Case counts only if the query has a capital.
    """
    needle = query if any(map(str.isupper, query)) else query.lower()
    hay = name if needle is query and query != query.lower() else name.lower()
    if not needle:
        return 0, []
    n, m = len(needle), len(hay)
    if len(hay) != len(name):
        name = hay
    bonus = []
    for i, c in enumerate(name):
        before = name[i - 1] if i else " "
        if c.isalnum() and not before.isalnum():
            bonus.append(BOUNDARY)
        elif c.isupper() and before.islower() or c.isdigit() and not before.isdigit():
            bonus.append(CAMEL)
        else:
            bonus.append(0)
    low = -(10**9)
    score = [[low] * m for _ in range(n)]
    run = [[0] * m for _ in range(n)]
    back = [[-1] * m for _ in range(n)]
    for i, c in enumerate(needle):
        gap, gap_at = low, -1
        for j in range(m):
            if i and j >= 2:
                # best end of the previous character that leaves a gap before j
                opened = score[i - 1][j - 2] - GAP_START
                if opened >= gap - GAP_MORE:
                    gap, gap_at = opened, j - 2
                else:
                    gap -= GAP_MORE
            if hay[j] != c:
                continue
            if not i:
                score[0][j], run[0][j] = MATCH + FIRST_BONUS * bonus[j], bonus[j]
                continue
            if j and score[i - 1][j - 1] > low:
                held = max(run[i - 1][j - 1], bonus[j], CONSECUTIVE)
                score[i][j], run[i][j], back[i][j] = score[i - 1][j - 1] + MATCH + held, held, j - 1
            if gap > low // 2 and gap + MATCH + bonus[j] > score[i][j]:
                score[i][j], run[i][j], back[i][j] = gap + MATCH + bonus[j], bonus[j], gap_at
    best = max(range(m), key=lambda j: (score[-1][j], -j), default=-1)
    if best < 0 or score[-1][best] <= low // 2:
        return None
    at, path = best, []
    for i in range(n - 1, -1, -1):
        path.append(at)
        at = back[i][at]
    return score[-1][best], path[::-1]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def highlights(query: pd.Series, name: pd.Series) -> pd.Series:
    """Character positions of the match, sorted; empty without one."""
    return pd.Series([(fuzzy_match(q or "", n or "") or (0, []))[1] for q, n in zip(query, name)])


#: Characters of names that a task compares at once.
HELD_CHARS = 1 << 20


def _by_characters(batches):
    """The batches in parts of at most HELD_CHARS bytes of names, or of one name."""
    for batch in batches:
        ends, at = np.cumsum(pc.binary_length(batch.column("name")).to_numpy(zero_copy_only=False)), 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_CHARS, side="right")))
            yield batch.slice(at, until - at)
            at = until


def _search_names(block: list[tuple[int, str]], most: int):
    """Task: the best ``most`` names of each query in the batches it sees."""

    def run(batches):
        best = {q: fuzzy.Best(most) for q, _ in block}
        kind = None
        for batch in _by_characters(batches):
            kind = batch.schema.field("id").type
            ids, shown = batch.column("id").to_numpy(zero_copy_only=False), batch.column("name").to_pylist()
            factor, names = batch.column("factor").to_numpy(), np.array(shown, object)
            forms = {}
            for q, text in block:
                if not text.strip():
                    best[q].add(np.zeros(len(ids), np.int64), ids, names)
                    continue
                fold = fuzzy.folds(text)
                if fold not in forms:
                    forms[fold] = fuzzy.Names(shown, fold)
                fuzzy.search(best[q], text, forms[fold], names, ids, factor)
        for q, found in best.items():
            if len(found.score):
                yield pa.record_batch([pa.array(np.full(len(found.score), q, np.int32)), pa.array(found.id, kind), pa.array(found.name, pa.string()), pa.array(found.score)], ["at", "id", "name", "score"])

    return run


#: Queries that one pass over the names answers.
QUERY_BLOCK = 1024


def rank_names(names: DataFrame, queries: DataFrame, most: int = 50, usage: DataFrame | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, name, score, place): names(id, name) by fuzzy score times boost of usage(id, used), ties by id.

    usage may have ``external``, another record of the same uses: the larger of the two counts. Queries go to the
    tasks in blocks of bounded length; a task aligns only names whose bound reaches its best so far and sends on
    at most ``most`` names a query, so names meet by those alone. Several blocks are written in turn.

    Defined cases: a blank query lists the first ids; null names, ids and queries match nothing; ids and query ids may
    repeat, each row counts; no names or no queries give no rows; other columns are ignored.
    """
    spark = names.sparkSession
    rows = names.where("id is not null and name is not null").select("id", "name")
    if usage is None:
        rows = rows.withColumn("factor", F.lit(1.0))
    else:
        uses = F.greatest("used", "external") if "external" in usage.columns else F.col("used")
        rows = rows.join(usage.groupBy("id").agg(F.max(uses).alias("used")), "id", "left").select("id", "name", boost(F.col("used")).alias("factor"))
    id_type, query_type = names.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)

    def searched(asked: list) -> DataFrame:
        found = rows.mapInArrow(_search_names([(i, r.text) for i, r in enumerate(asked)], most), f"at int, id {id_type}, name string, score long")
        keys = spark.createDataFrame([(i, r.query_id) for i, r in enumerate(asked)], f"at int, query_id {query_type}")
        return found.join(F.broadcast(keys), "at").select("query_id", "id", "name", "score")

    left = queries.where("text is not null").select("query_id", "text").toLocalIterator()
    blocks = iter(lambda: list(itertools.islice(left, block)), [])
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return ranked(searched(first))
    path = scratch.fresh(spark, "names")
    for asked in itertools.chain([first, second], blocks):
        ranked(searched(asked)).drop("place").write.mode("append").parquet(path)
    return ranked(spark.read.parquet(path))


#: Characters of a clip that are searched (fixed value).
CLIP_CHARS = 500


def search_clips(history: DataFrame, text: str, most: int = 50) -> DataFrame:
    """history(clip, text, pinned, front) with ``place``: by fuzzy score over the first 500 characters; a blank text lists pinned clips, then the newest.

    Ties are listed as a blank text lists them; a null text matches nothing; an empty history gives no rows.
    """
    if not text.strip():
        newest = Window.orderBy(F.desc("pinned"), F.desc("front"), "clip")
        few = history.select("clip", "text", "pinned", "front").orderBy(F.desc("pinned"), F.desc("front"), "clip").limit(most)
        return few.withColumn("place", F.row_number().over(newest))
    asked = history.sparkSession.createDataFrame([(0, text)], "query_id int, text string")
    # a key that sorts as the list does decides ties
    age = F.lpad((F.lit(1 << 62) - F.col("front").cast("long")).cast("string"), 20, "0")
    clip = F.col("clip").cast("string")
    if history.schema["clip"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        clip = F.lpad((F.col("clip").cast("decimal(20,0)") + F.lit(1 << 62).cast("decimal(20,0)") * 2).cast("string"), 20, "0")
    keyed = history.select("clip", "text", "pinned", "front", F.concat(F.when(F.col("pinned"), "0").otherwise("1"), age, F.lit(":"), clip).alias("key"))
    found = rank_names(keyed.select(F.col("key").alias("id"), F.substring("text", 1, CLIP_CHARS).alias("name")), asked, most)
    return keyed.join(F.broadcast(found.select(F.col("id").alias("key"), "score", "place")), "key").drop("key")


def matching_commands(commands: DataFrame, text: str) -> DataFrame:
    """commands(title, keywords) of which the title, a word of it or a keyword starts with the text; texts under three characters match nothing."""
    plain = " ".join(text.split()).lower()
    if len(plain) < 3:
        return commands.where(F.lit(False))
    title = F.lower(F.regexp_replace("title", "…+$", ""))
    starts = lambda x: F.startswith(x, F.lit(plain))
    words = F.exists(F.split(title, r"\s+"), starts)
    keys = F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.coalesce(starts(k), F.lit(False)))
    return commands.where(F.coalesce(words, F.lit(False)) | F.coalesce(starts(title), F.lit(False)) | keys)


def merged_lanes(*lanes: DataFrame, key_column: str = "id", most: int | None = None) -> DataFrame:
    """Lanes one after the other, each ordered by its ``position``; a key stays in the first lane that has it."""
    rows = None
    for i, lane in enumerate(lanes):
        one = lane.withColumn("lane", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    first = Window.partitionBy(key_column).orderBy("lane", "position")
    kept = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").orderBy("lane", "position", key_column)
    return kept if most is None else kept.limit(most)


def welcome(apps: DataFrame, files: DataFrame, rows: int) -> DataFrame:
    """apps(id, used_score) and files(id, last_used): files get up to half the rows, apps the rest."""
    recent = files.orderBy(F.desc("last_used"), "id").limit(rows // 2)
    n_recent = recent.agg(F.count("*").alias("n"))
    best = apps.orderBy(F.desc("used_score"), "id").limit(rows).withColumn("position", F.row_number().over(Window.orderBy(F.desc("used_score"), "id")))
    chosen = best.join(n_recent).where(F.col("position") <= rows - F.col("n")).select("id", F.lit("app").alias("kind"), "position")
    filed = recent.withColumn("position", F.row_number().over(Window.orderBy(F.desc("last_used"), "id"))).select("id", F.lit("file").alias("kind"), "position")
    return chosen.unionByName(filed)


def substring_rank(title: Column, keyword: Column, body: Column, query: Column) -> Column:
    """0 prefix of the title, 1 in the keyword, 2 in title or body, null otherwise."""
    q = F.lower(F.trim(query))
    return F.when(F.startswith(F.lower(title), q), 0).when(F.contains(F.lower(keyword), q), 1).when(F.contains(F.lower(title), q) | F.contains(F.lower(body), q), 2)


def all_words_in(query: Column, *fields: Column) -> Column:
    """Every word of the query occurs somewhere in the fields."""
    text = F.lower(F.concat_ws(" ", *fields))
    return F.forall(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""), lambda w: F.contains(text, w))


def completions(commands: DataFrame, prefix: str) -> DataFrame:
    return commands.where(F.startswith(F.lower("name"), F.lit(prefix.lower()))).orderBy("name")


def by_recency(commands: DataFrame, recent: DataFrame) -> DataFrame:
    """commands(id, offset) with the 32 most recent of recent(id, at) first, the rest in their order."""
    last = recent.groupBy("id").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "id").limit(32)
    return commands.join(last, "id", "left").orderBy(F.desc_nulls_last("at"), "offset")
