"""Word search: postings, BM25, strict and relaxed lanes, for many queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import question_terms, required_terms, tokens

K1, B = 1.2, 0.75
RESULTS, RELAX_BELOW = 100, 3
DOCUMENT_WEIGHTS = {"title": 4.0, "body": 1.0}
PASSAGE_WEIGHTS = {"heading": 2.0, "text": 1.0, "symbols": 1.0}


@dataclass
class WordIndex:
    """postings(term, id, tf, length) with column weights applied to tf, and lengths(id, length), both in tokens.

    ``buckets`` is the number of term buckets of a stored index, whose postings have their ``bucket``.
    """

    postings: DataFrame
    lengths: DataFrame
    buckets: int | None = None

    def written(self, path: str, buckets: int = 64) -> WordIndex:
        """The index on storage: postings in folders by hash of the term, so a query lists and reads only its terms' buckets."""
        self.postings.withColumn("bucket", bucket_of(buckets)).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        spark = self.postings.sparkSession
        return WordIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), buckets)

    def of(self, terms: DataFrame) -> DataFrame:
        """Postings of terms(term), spread by term."""
        wanted = terms.select("term").distinct()
        rows = self.postings
        if self.buckets is not None:
            # at most as many numbers as there are buckets
            here = [r.bucket for r in wanted.select(bucket_of(self.buckets).alias("bucket")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(here)).drop("bucket")
        return rows.join(wanted, "term", "left_semi").repartition("term")


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def word_index(rows: DataFrame, key: str, weights: dict[str, float]) -> WordIndex:
    """Index of rows(key, columns of weights). Counting is per row before the shuffle: a row's tokens sit together."""
    plain = rows.select(F.col(key).alias("id"), *[tokens(F.col(c)).alias(c) for c in weights])

    def weighted(column: str, weight: float) -> Column:
        return F.transform(column, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("tf")))

    parts = F.flatten(F.array(*[weighted(c, w) for c, w in weights.items()]))
    total = sum((F.size(c) for c in weights), F.lit(0)).cast("long")
    postings = plain.select("id", total.alias("length"), F.explode(parts).alias("p")).groupBy("p.term", "id", "length").agg(F.sum("p.tf").alias("tf"))
    return WordIndex(postings, plain.select("id", total.alias("length")))


def scored(index: WordIndex, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, facts): hits(query_id, id, term, score) for terms(query_id, term), Okapi BM25, larger is better; facts(term, df, ...).

    Frequencies and scores read one exchange of the terms' postings.
    """
    held = index.of(terms)
    stats = index.lengths.agg(F.count("*").alias("n_rows"), F.avg("length").alias("mean_length"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    n = F.col("n_rows").cast("double")
    idf = F.greatest(F.lit(1e-6), F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    # one row of corpus totals and one row a query term: both bounded by the queries
    facts = df.join(stats).select("term", "df", idf.alias("idf"), "mean_length")
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    rows = held.join(facts, "term").select("term", "id", weight.alias("score"))
    return terms.join(rows, "term"), facts


def _strict(terms: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, id, score) of rows that have all of a query's terms."""
    need = terms.groupBy("query_id").agg(F.countDistinct("term").alias("need"))
    whole = hits.groupBy("query_id", "id").agg(F.count("*").alias("have"), F.sum("score").alias("score"))
    return whole.join(need, "query_id").where("have = need").select("query_id", "id", "score")


def _top(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most)


def _required(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(required_terms(F.col("text"))).alias("term"))


def search_documents(index: WordIndex, queries: DataFrame, most: int = RESULTS, broad: int | None = None) -> DataFrame:
    """(query_id, id, rank, limited, place): documents with all terms of queries(query_id, text).

    All of them are ranked (rank is minus BM25, smaller first). If ``broad`` is given, a query with a term in more than
    ``broad`` documents is limited: newest ids, rank 0. Otherwise the newest ``broad`` + 1 matches are ranked; more
    matches than that mark it limited.
    """
    terms = _required(queries)
    hits, facts = scored(index, terms)
    if broad is None:
        ranked = _strict(terms, hits).select("query_id", "id", (-F.round("score", 9)).alias("rank"), F.lit(False).alias("limited"))
        return _top(ranked, [F.col("rank"), F.desc("id")], most)
    wide = terms.join(facts, "term").groupBy("query_id").agg((F.max("df") > broad).alias("wide"))
    newest = _top(_strict(terms, hits).join(wide, "query_id"), [F.desc("id")], broad + 1)
    full = F.count("*").over(Window.partitionBy("query_id")) > broad
    ranked = newest.select("query_id", "id", F.when(F.col("wide"), 0.0).otherwise(-F.round("score", 9)).alias("rank"), (F.col("wide") | full).alias("limited"))
    return _top(ranked, [F.col("rank"), F.desc("id")], most)


def search_any(index: WordIndex, queries: DataFrame, most: int = RESULTS) -> DataFrame:
    """(query_id, id, rank, place): documents with any distinctive term of a question."""
    terms = queries.select("query_id", F.explode(question_terms(F.col("text"))).alias("term"))
    found = scored(index, terms)[0].groupBy("query_id", "id").agg((-F.round(F.sum("score"), 9)).alias("rank"))
    return _top(found, [F.col("rank"), F.col("id")], most)


def search_strict(index: WordIndex, queries: DataFrame, most: int = RESULTS, newest_first: bool = False) -> DataFrame:
    """(query_id, id, rank, place): the strict lane of ``search_passages`` alone; ties by id, or the newest first."""
    terms = _required(queries)
    found = _strict(terms, scored(index, terms)[0])
    return _top(found.select("query_id", "id", (-F.round("score", 9)).alias("rank")), [F.col("rank"), F.desc("id") if newest_first else F.col("id")], most)


def search_passages(index: WordIndex, queries: DataFrame, scope: DataFrame | None = None, most: int = RESULTS) -> DataFrame:
    """(query_id, id, rank, relaxed, place): strict lane, then, below three hits, the relaxed lane after it.

    ``scope``(id) restricts rows before any limit. The relaxed lane takes the question's terms, or all terms
    where it has none, and follows the strict lane only for queries of several terms. One sum by query and row
    serves both lanes.
    """
    loose = F.when(F.size(question_terms(F.col("text"))) > 0, question_terms(F.col("text"))).otherwise(required_terms(F.col("text")))
    loose_terms = queries.where(F.size(required_terms(F.col("text"))) > 1).select("query_id", F.explode(loose).alias("term"))
    strict_terms = _required(queries)
    named = strict_terms.withColumn("must", F.lit(True)).unionByName(loose_terms.withColumn("must", F.lit(False)))
    named = named.groupBy("query_id", "term").agg(F.bool_or("must").alias("must"), F.bool_or(~F.col("must")).alias("may"))
    hits = scored(index, named)[0]
    if scope is not None:
        hits = hits.join(scope.select("id").distinct(), "id", "left_semi")
    need = strict_terms.groupBy("query_id").agg(F.countDistinct("term").alias("need"))
    part = lambda flag: F.sum(F.when(F.col(flag), F.col("score")))
    whole = hits.groupBy("query_id", "id").agg(F.count_if("must").alias("have"), part("must").alias("all_score"), part("may").alias("any_score"))
    whole = whole.join(need, "query_id").withColumn("relaxed", F.col("have") < F.col("need"))
    rows = whole.where("not relaxed or any_score is not null").select("query_id", "id", "relaxed", (-F.round(F.when(F.col("relaxed"), F.col("any_score")).otherwise(F.col("all_score")), 9)).alias("rank"))
    lane = Window.partitionBy("query_id", "relaxed").orderBy("rank", "id")
    best = rows.withColumn("n", F.row_number().over(lane)).where(F.col("n") <= most)
    # at most twice ``most`` rows a query are left here
    strict = F.count_if(~F.col("relaxed")).over(Window.partitionBy("query_id"))
    lanes = best.withColumn("strict", strict).where(~F.col("relaxed") | (F.col("strict") < RELAX_BELOW)).select("query_id", "id", "rank", "relaxed")
    return _top(lanes, [F.col("relaxed"), F.col("rank"), F.col("id")], most)


def best_passage(hits: DataFrame, passages: DataFrame, most: int = RESULTS) -> DataFrame:
    """hits(query_id, id, rank, ...) cut to the best passage of each document of passages(id, document_id, ...)."""
    joined = hits.drop("place").join(passages, "id")
    by_document = Window.partitionBy("query_id", "document_id").orderBy("rank", "id")
    first = joined.withColumn("n", F.row_number().over(by_document)).where("n = 1").drop("n")
    return _top(first, [F.col("rank"), F.col("document_id")], most)
