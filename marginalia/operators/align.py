"""Cross-checking two sources of the same texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import few, staged
from . import closest

#: Similarity from which a match is verified, and from which it is worth a look.
VERIFIED, REVIEW = 0.80, 0.60


def best_matches(left: DataFrame, right: DataFrame, left_key: str, right_key: str, terms: str = "terms", pairs: bool = False) -> DataFrame:
    """left_key, right_key, similarity: for each left text the most similar right one (the smaller key
    of equal ones).  Both hold an array of terms, with pairs one of words of which two neighbours are a term as well; the vocabulary is that of the right
    side.  A left text that shares no term is as far from all right ones: it has the first of them, with similarity 0."""
    numbers = [_numbered(df, key, terms, name) for df, key, name in ((left, left_key, "_left"), (right, right_key, "_key"))]
    found = left.sparkSession.createDataFrame(closest.closest(*numbers, terms, pairs))
    found = F.broadcast(found) if few(found) else found
    best = found.select("_left", "_key", "score")
    for numbered, key, name in ((numbers[0], left_key, "_left"), (numbers[1], right_key, "_key")):
        kind = dict(numbered.dtypes)[key]
        best = best.withColumn(key, F.col(name).cast(kind)) if kind in WHOLE else best.join(numbered.select(name, key), name)
    best = best.groupBy(left_key).agg(F.min(F.struct((-F.col("score")).alias("_s"), right_key)).alias("_b"))
    first = right.agg(F.min(right_key).alias("_first"))
    every = left.select(left_key).distinct().join(best, left_key, "left").crossJoin(F.broadcast(first))  # one row
    return every.where("_first is not null").select(left_key, F.coalesce(f"_b.{right_key}", "_first").alias(right_key), F.coalesce(-F.col("_b._s"), F.lit(0.0)).alias("similarity"))


WHOLE = ("bigint", "int")


def _numbered(df: DataFrame, key: str, terms: str, name: str) -> DataFrame:
    """key, its number, in the order of the key, and terms."""
    if dict(df.dtypes)[key] in WHOLE:
        return df.select(key, F.col(key).cast("long").alias(name), terms).where(F.col(key).isNotNull())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(df.select(key, terms).repartitionByRange(parts, key).sortWithinPartitions(key).withColumn(name, F.monotonically_increasing_id()), "numbered")


def with_status(matches: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """status: of several claims on one right text the most similar wins (the first of equal ones) and
    the others are contested; a winner is verified, worth a review or unmatched."""
    w = Window.partitionBy(right_key).orderBy(F.desc("similarity"), left_key)
    first = F.row_number().over(w) == 1
    status = F.when(first & (F.col("similarity") >= VERIFIED), "verified").when(~first, "contested").when(F.col("similarity") >= REVIEW, "review").otherwise("unmatched")
    return matches.withColumn("status", status)


def match_stats(matches: DataFrame, left_total: int, right_total: int) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("verified", "review", "contested", "unmatched")]
    return matches.agg(F.lit(left_total).cast("long").alias("left_total"), F.lit(right_total).cast("long").alias("right_total"), *counts)


def similarity_spread(matches: DataFrame) -> DataFrame:
    """Percentiles of similarity over all matches; word deltas over verified ones (right minus left)."""
    delta = F.when(F.col("status") == "verified", F.col("right_words") - F.col("left_words"))
    points = [F.round(F.percentile("similarity", p), 6).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)]
    return matches.agg(*points, F.round(F.avg(delta), 6).alias("delta_mean"), F.median(delta).alias("delta_median"), F.count_if(F.abs(delta) > 5).alias("far"), F.round(F.avg((F.abs(delta) > 5).cast("int")), 6).alias("far_share"))


def verified_records(records: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Every record, with whether a verified match stands behind it, its similarity and word delta."""
    good = matches.where("status = 'verified'").select(key, F.round("similarity", 4).alias("similarity"), (F.col("right_words") - F.col("left_words")).alias("word_delta"))
    return records.join(good, key, "left").withColumn("verified", F.col("similarity").isNotNull())


def flagged(matches: DataFrame, k: int = 10) -> DataFrame:
    """The least similar matches that aren't verified."""
    return matches.where("status <> 'verified'").orderBy("similarity", *[c for c in matches.columns if c.endswith("_id")]).limit(k)
