"""Building a corpus: editions, the second source, verification and grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import align
from ..shared import staged


def graded(records: DataFrame) -> DataFrame:
    g = rules.grade(F.col("grades"))
    return records.withColumn("_g", g).withColumn("grade_verdict", F.col("_g.verdict")).withColumn("grade_label", F.col("_g.label")).drop("_g")


def corpus(collections: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(the records of all collections without weak ones, how many of each collection were weak).  It
    fails where an id occurs twice.  corpus_ord orders the records: as the collections come, and in each by
    `ord` if it has that, else by id."""
    placed = [c.withColumn("corpus_ord", F.struct(F.lit(i).alias("collection"), (F.col("ord").cast("long") if "ord" in c.columns else F.lit(0).cast("long")).alias("ord"), F.col("id").cast("string").alias("id"))) for i, c in enumerate(collections)]
    every = graded(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed))
    if every.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("an id occurs twice")
    weak = every.where("grade_verdict = 'weak'").groupBy("collection").agg(F.count("*").alias("n"))
    return every.where("grade_verdict <> 'weak'"), weak


def cross_checked(records: DataFrame, second: DataFrame, folds: list[tuple[str, str]] = (), order: str = "corpus_ord") -> tuple[DataFrame, DataFrame]:
    """(records with their verification, all matches).  second has a key `second_id`; of equally similar
    records that which comes first in `order`, a unique column, is the match."""
    nfkd = tx.decomposed()
    terms = lambda text: tx.word_grams(tx.tokens(tx.normalised(nfkd(text), list(folds))), 1, 2)
    left = second.select("second_id", terms(tx.indexed_text(F.col("narrator"), F.col("text"))).alias("terms"), tx.word_count(F.col("text")).alias("left_words"))
    right = records.select(order, terms(F.col("text")).alias("terms"), tx.word_count(F.col("text")).alias("right_words"))
    found = align.best_matches(left, right, "second_id", order)
    found = found.join(left.select("second_id", "left_words"), "second_id").join(right.select(order, "right_words"), order)
    matches = staged(align.with_status(found, "second_id", order), "matches")
    return align.verified_records(records, matches, order), matches
