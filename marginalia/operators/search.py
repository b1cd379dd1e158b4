"""From scores to answers: ranks, fusion of rankings, the gate, and what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .postings import query_blocks

#: The damping and weights of the fused score, and the gate on vector similarity.
DAMPING = 60
CHAR_WEIGHT = 0.5
GATE = 0.55


def ranked(scored: DataFrame, query_key: str, order: str, name: str = "rank") -> DataFrame:
    """Unique ranks from 1 by falling score, ties in the order of `order`."""
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), order)
    return scored.withColumn(name, F.row_number().over(w).cast("long"))


def top(scored: DataFrame, query_key: str, order: str, k: int) -> DataFrame:
    """The k best of each query; tasks keep no more than k of a query before the shuffle."""
    return ranked(scored, query_key, order).where(F.col("rank") <= k)


def complete(scored: DataFrame, queries: DataFrame, items: DataFrame, query_key: str, key: str, most_queries: int = 4096) -> DataFrame:
    """Scores of all pairs of a query and an item, 0 where nothing is shared: fused ranks need complete
    rankings.  A stated set of queries against all items, in broadcast blocks of bounded size."""
    pairs = None
    for block in query_blocks(queries.select(query_key), query_key, most_queries):
        one = F.broadcast(block).join(items.select(key), F.lit(True))
        pairs = one if pairs is None else pairs.unionByName(one)
    return pairs.join(scored, [query_key, key], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def best_part(scored: DataFrame, query_key: str, key: str, order: str, *carried: str) -> DataFrame:
    """The best part of each document: the greatest score, of equal ones the first part."""
    best = F.min(F.struct((-F.col("score")).alias("_s"), order, *carried)).alias("_b")
    return scored.groupBy(query_key, key).agg(best).select(query_key, key, (-F.col("_b._s")).alias("score"), *(f"_b.{c}" for c in (order, *carried)))


def fused(word: DataFrame, vector: DataFrame | None, char: DataFrame | None, query_key: str, key: str, n_parts: int) -> DataFrame:
    """Reciprocal rank fusion of rankings that hold query_key, key, score and rank.  A document must be in
    the word ranking, and in that of vectors if there is one; without a character rank it counts as ranked
    n_parts there."""
    both = word.select(query_key, key, F.col("score").alias("word_score"), F.col("rank").alias("word_rank"))
    value = 1.0 / (DAMPING + F.col("word_rank"))
    if vector is not None:
        both = both.join(vector.select(query_key, key, F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank")), [query_key, key])
        value = value + 1.0 / (DAMPING + F.col("vector_rank"))
    if char is not None:
        both = both.join(char.select(query_key, key, F.col("rank").alias("char_rank")), [query_key, key], "left")
        both = both.withColumn("char_rank", F.coalesce("char_rank", F.lit(n_parts)))
        value = value + CHAR_WEIGHT / (DAMPING + F.col("char_rank"))
    return both.withColumn("score", F.round(value, 8))


def confident(vector_score: Column, gate: float = GATE) -> Column:
    return vector_score >= gate


def reranked(candidates: DataFrame, query_key: str, order: str, scorer: Column, pool: int = 10, k: int = 3) -> DataFrame:
    """The k best of the first `pool` candidates by another score, which is worked out for the pool only."""
    kept = candidates.where(F.col("rank") <= pool).withColumn("first_rank", F.col("rank")).withColumn("score", scorer)
    return ranked(kept.drop("rank"), query_key, order).where(F.col("rank") <= k)


def relevant(candidates: DataFrame, verdicts: DataFrame, query_key: str, k: int = 10) -> DataFrame:
    """The first k candidates of which the judge's verdict (query_key, rank, answers, why) is yes, in
    their order.  An unread verdict is no yes."""
    return candidates.where(F.col("rank") <= k).join(verdicts, [query_key, "rank"]).where(F.coalesce("answers", F.lit(False)))


def shown(candidates: DataFrame, verdicts: DataFrame, query_key: str, words: str = "n_words", k: int = 3) -> DataFrame:
    """What a question shows: the k shortest of the candidates that answer it, or, where the judge couldn't be
    asked (degraded), the first k as they were found; `place` numbers them."""
    both = candidates.join(verdicts, [query_key, "rank"]).where(F.col("degraded") | F.coalesce("answers", F.lit(False)))
    w = Window.partitionBy(query_key).orderBy(F.when(F.col("degraded"), 0).otherwise(F.col(words)), "rank")
    return both.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def shortest_first(candidates: DataFrame, query_key: str, words: str = "n_words", k: int = 3) -> DataFrame:
    """The k shortest texts of a query, ties by rank; `place` numbers them."""
    w = Window.partitionBy(query_key).orderBy(words, "rank")
    return candidates.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def page(rows: DataFrame, order: list, offset: int, limit: int, most: int = 20) -> DataFrame:
    """One page of ordered rows; a page has 1 to `most` rows."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))
