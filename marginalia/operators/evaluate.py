"""Evaluation of retrieval against expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import few


def case_results(cases: DataFrame, answers: DataFrame, key: str, k: int = 3) -> DataFrame:
    """ok for each case (key, expected array, expect, reject): one of the first k answers (key, rank,
    answer, confident) is expected and confident; a case to reject is ok without a confident answer."""
    good = answers.where((F.col("rank") <= k) & F.col("confident"))
    got = good.groupBy(key).agg(F.collect_set("answer").alias("got"))
    both = cases.join(got, key, "left").withColumn("got", F.coalesce("got", F.array().cast(dict(cases.dtypes)["expected"])))
    return both.withColumn("ok", F.when(F.col("reject"), F.size("got") == 0).otherwise(F.arrays_overlap("expected", "got")))


def summary(results: DataFrame) -> DataFrame:
    """Firm cases passed and all, firm cases that fail, and known failures that still fail or now pass."""
    firm, known = F.col("expect") == "pass", F.col("expect") == "known_failure"
    return results.agg(
        F.count_if(firm).alias("firm"), F.count_if(firm & F.col("ok")).alias("passed"), F.count_if(firm & ~F.col("ok")).alias("regressions"),
        F.count_if(known & ~F.col("ok")).alias("still_failing"), F.count_if(known & F.col("ok")).alias("now_passing"),
    )


def first_relevant(scored: DataFrame, key: str, order: str, relevant: str) -> DataFrame:
    """key and first, the rank of the best relevant answer by falling score and `order` (null without one).

    Nothing is ranked: the best relevant answer of each query is a minimum, and its rank the number of answers
    that come no later, which tasks count before they meet."""
    place = F.struct((-F.col("score")).alias("s"), F.col(order).alias("o"))
    best = scored.where(F.col(relevant)).groupBy(key).agg(F.min(place).alias("_best"))
    placed = scored.join(F.broadcast(best) if few(best) else best, key, "left")
    return placed.groupBy(key).agg(F.nullif(F.count_if(place <= F.col("_best")), F.lit(0)).alias("first"))


def recall_at(first: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of queries with a relevant answer among the first k, and the mean reciprocal rank."""
    shares = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6).alias(f"recall_{k}") for k in ks]
    return first.agg(F.count("*").alias("queries"), *shares, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def gain(pairs: DataFrame, key: str, gate: float = 0.44) -> DataFrame:
    """What generated questions add: for each question the best score with a record's own parts and with
    generated ones (kind "text" or "question"), then their means and counts."""
    best = pairs.groupBy(key).agg(F.max(F.when(F.col("kind") == "text", F.col("score"))).alias("own"), F.max("score").alias("both"))
    return best.agg(
        F.count("*").alias("questions"), F.round(F.avg("own"), 6).alias("own_mean"), F.round(F.avg("both"), 6).alias("both_mean"),
        F.count_if(F.col("both") > F.col("own")).alias("improved"), F.count_if(F.col("own") >= gate).alias("own_over"), F.count_if(F.col("both") >= gate).alias("both_over"),
    )


def candidate_cases(votes: DataFrame, question: str, chosen: str, limit: int) -> DataFrame:
    """Agreed picks as lines of new cases, most votes first."""
    agreed = votes.where("not split")
    w = Window.orderBy(F.desc("votes"), question)
    line = F.format_string('{"query": "%s", "expected_ids": ["%s"], "expect": "pass"}', F.col(question).cast("string"), F.col(chosen).cast("string"))
    return agreed.orderBy(F.desc("votes"), question).limit(limit).select(F.row_number().over(w).cast("long").alias("place"), question, chosen, line.alias("line"))
