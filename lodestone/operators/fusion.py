"""Rank fusion, per-document selection with overlap removal, context budgets."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIST_CAP, OFFSET, LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 100, 61, 2.0, 1.0
PER_DOCUMENT, RESULTS, MEANING_ONLY = 2, 100, 8
CONTEXT_PASSAGES, CONTEXT_BYTES, PASSAGE_BYTES, STOP_BELOW = 5, 7000, 1800, 400


def fuse_ranks(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(query_id, id, score, words, meaning, place) of two lists (query_id, id, position from 0).

    Reciprocal ranks, the first 100 positions of each; a repeated id counts once, at its first position.
    """

    def lane(df: DataFrame, weight: float, words: bool) -> DataFrame:
        first = df.where(F.col("position") < LIST_CAP).groupBy("query_id", "id").agg(F.min("position").alias("position"))
        return first.select("query_id", "id", (weight / (OFFSET + F.col("position"))).alias("score"), F.lit(words).alias("words"))

    rows = lane(lexical, LEXICAL_WEIGHT, True).unionByName(lane(semantic, SEMANTIC_WEIGHT, False))
    merged = rows.groupBy("query_id", "id").agg(F.round(F.sum("score"), 12).alias("score"), F.bool_or("words").alias("words"), F.bool_or(~F.col("words")).alias("meaning"))
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def _runs_into(left: bytes, right: bytes, least: int) -> bool:
    """Some suffix of left of ``least`` bytes or more begins right. Both are UTF-8, so it starts at a character."""
    probe = right[:least]
    at = left.find(probe, max(0, len(left) - len(right)))
    while at >= 0 and not right.startswith(left[at:]):
        at = left.find(probe, at + 1)
    return at >= 0


def _overlap(left: str, right: str) -> bool:
    if not left or not right:
        return left == right
    x, y = left.encode(), right.encode()
    least = min(len(x), len(y)) * 4 // 5
    return x in y or y in x or _runs_into(x, y, least) or _runs_into(y, x, least)


def substantially_overlaps(left: Column, right: Column) -> Column:
    """Equal, contained, or a suffix of four fifths of the shorter that begins the other."""

    @F.pandas_udf(T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and _overlap(x, y) for x, y in zip(a, b)])

    return run(left, right)


def select_fused(ranked: DataFrame, passages: DataFrame, per_document: int = PER_DOCUMENT, most: int = RESULTS) -> DataFrame:
    """Fused ranks cut to ``per_document`` passages of each document without substantial overlap.

    ranked(query_id, id, score, place, ...) and passages(id, document_id, text). A group is a query's ranked
    rows, at most 200, of many documents with a row or two each.
    """
    columns = [c for c in ranked.columns if c != "place"]
    # the ranked rows go to the passages, of which only they move on
    joined = passages.select("id", "document_id", "text").join(F.broadcast(ranked), "id").select("document_id", "text", "place", *columns)

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        keep: dict[object, list[str]] = {}
        ordered, at = group.sort_values("place", kind="stable"), []
        for i, (document, text) in enumerate(zip(ordered["document_id"], ordered["text"])):
            texts = keep.setdefault(document, [])
            if len(texts) < per_document and not any(_overlap(t, text) for t in texts):
                texts.append(text)
                at.append(i)
        return ordered.iloc[at]

    kept = joined.groupBy("query_id").applyInPandas(greedy, joined.schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return kept.withColumn("place", place).where(F.col("place") <= most)


def fuse_documents(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Document-level fusion: all lexical results first, at most eight meaning-only ones after them.

    Lists are (query_id, id, position). A lexical result scores 2/(61+r), plus 1/(61+r') where both agree.
    """
    both = lexical.withColumnRenamed("position", "r").join(semantic.withColumnRenamed("position", "s"), ["query_id", "id"], "full")
    rows = both.select("query_id", "id", F.col("r").isNotNull().alias("words"), F.col("s").isNotNull().alias("meaning"), (F.coalesce(LEXICAL_WEIGHT / (OFFSET + F.col("r")), F.lit(0.0)) + F.coalesce(SEMANTIC_WEIGHT / (OFFSET + F.col("s")), F.lit(0.0))).alias("score"))
    lane = Window.partitionBy("query_id", "words").orderBy(F.desc("score"), "id")
    kept = rows.withColumn("n", F.row_number().over(lane)).where(F.col("words") | (F.col("n") <= MEANING_ONLY)).drop("n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("words"), F.desc("score"), "id")))


def context(selected: DataFrame) -> DataFrame:
    """(query_id, place, id, text): passages for a question within the byte budget, in rank order.

    selected(query_id, id, place, text), at most 100 a query; each query's budget is a fold over its rows.
    """

    def budget(group: pd.DataFrame) -> pd.DataFrame:
        left, out = CONTEXT_BYTES, []
        for row in group.sort_values("place").head(CONTEXT_PASSAGES).itertuples(index=False):
            if left < STOP_BELOW:
                break
            text = row.text.encode()[: min(PASSAGE_BYTES, left)].decode("utf-8", "ignore")
            left -= len(text.encode())
            out.append((row.query_id, row.place, row.id, text))
        return pd.DataFrame(out, columns=["query_id", "place", "id", "text"])

    rows = selected.select("query_id", "place", "id", "text")
    return rows.groupBy("query_id").applyInPandas(budget, rows.schema)


def best_window(body: str, terms: list[str], budget: int) -> str | None:
    """The window of ``budget`` bytes with most terms (100 each, plus occurrences); the first of equals.

    Windows begin half a window apart, and begin and end on whole characters.
    """
    text = " ".join(body.split())
    if not text or budget <= 0:
        return None
    edges = list(accumulate((len(c.encode()) for c in text), initial=0))
    last = len(text)
    at_byte = lambda b: bisect_right(edges, b) - 1
    until = lambda i: at_byte(edges[i] + budget)
    starts = [0]
    while starts[-1] < until(starts[-1]) < last:
        starts.append(max(starts[-1] + 1, at_byte(edges[starts[-1]] + max(1, min(budget, edges[-1]) // 2))))
    wanted = [t for t in terms if t]
    spans = [text[i : until(i)].lower() for i in starts]
    scores = [sum(100 + s.count(t) for t in wanted if t in s) for s in spans]
    best = starts[scores.index(max(scores))]
    return text[best : until(best)]


def best_windows(rows: DataFrame, budget: int) -> DataFrame:
    """rows(id, body, terms array<string>) with ``passage``, the best window of each body."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["id"]].assign(passage=[best_window(b or "", list(t) if t is not None else [], budget) for b, t in zip(f["body"], f["terms"])])

    return rows.select("id", "body", "terms").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, passage string")
