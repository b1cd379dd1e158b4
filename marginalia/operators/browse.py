"""Browsing: topics, fixed selections and the pick of a day."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.rules import Topic


def display_order(text: Column, topic: Column, topics: list[Topic]) -> tuple[Column, Column, Column]:
    """(length band, how many of the topic's words are in the text up to three, number of words)."""
    n = tx.word_count(text)
    band = F.when(n < 20, 0).when(n <= 120, 2).when(n <= 250, 1).otherwise(0)
    hits = lambda t: reduce(lambda a, b: a + b, (text.rlike("(?i)" + p).cast("int") for p in t.texts), F.lit(0))
    fit = reduce(lambda c, t: F.when(topic == t.label, F.least(hits(t), F.lit(3))).otherwise(c), topics, F.lit(0))
    return band, fit, n


def topic_index(records: DataFrame, topics: list[Topic], key: str, book: str = "book_name") -> DataFrame:
    """topic, place, key and text: the records of each topic's books, equal texts once (the first by
    key), best to show first.  The rules are a short list, so a record is tested where it is read and
    only its own topics are shuffled."""
    labels = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.col(book).rlike("(?i)" + p) for p in t.books)), F.lit(t.label)) for t in topics)))
    rows = records.where(F.col(book).isNotNull()).select(key, "text", F.explode(labels).alias("topic"))
    same = F.md5(F.lower(tx.collapsed(F.col("text"))))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("topic", same).orderBy(key))).where("_n = 1").drop("_n")
    band, fit, n = display_order(tx.collapsed(F.col("text")), F.col("topic"), topics)
    rows = rows.withColumns({"band": band, "fit": fit, "n_words": n})
    order = Window.partitionBy("topic").orderBy(F.desc("band"), F.desc("fit"), "n_words", key)
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def topic_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("topic").agg(F.count("*").alias("n"))


def featured(records: DataFrame, ids: list, key: str, spark: SparkSession) -> DataFrame:
    """The records of a fixed list, in its order; ids that aren't there are left out."""
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"place long, {key} {dict(records.dtypes)[key]}")
    return records.join(F.broadcast(wanted), key)


def looked_up(records: DataFrame, key: str, value) -> DataFrame:
    """The record of an id: a filter that reaches the scan."""
    return records.where(F.col(key) == F.lit(value))


def missing_ids(records: DataFrame, ids: list, key: str, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ids], f"{key} {dict(records.dtypes)[key]}").join(records, key, "left_anti")


def daily_picks(days: DataFrame, pool: list, day: str = "day") -> DataFrame:
    """The pick of each day: a digest of the date chooses from the pool."""
    place = tx.day_index(F.col(day), len(pool))
    return days.select(day, place.alias("place"), F.get(F.array(*map(F.lit, pool)), place.cast("int")).alias("pick"))


def days(spark: SparkSession, first: str, n: int) -> DataFrame:
    return spark.range(n).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))
