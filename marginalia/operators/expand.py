"""Chunks of records, generated questions beside them, and work that remains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def text_parts(text: Column, target: int = 45, ceiling: int = 180) -> Column:
    """Windows of sentences.  A blank text is one as it is."""
    return tx.let(tx.windows(tx.sentences(text), target, ceiling), lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(text)))


def text_chunks(records: DataFrame, key: str, target: int = 45, ceiling: int = 180) -> DataFrame:
    """key, chunk_index (text, as questions have others), ord, chunk_text, chunk_type: windows of
    sentences."""
    rows = records.select(key, F.posexplode(text_parts(F.col("text"), target, ceiling)).alias("ord", "chunk_text"))
    return rows.select(key, F.col("ord").cast("string").alias("chunk_index"), F.col("ord").cast("long").alias("ord"), "chunk_text", F.lit("text").alias("chunk_type"))


def question_chunks(records: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """The same for generated questions (key, questions array); blank ones are left out."""
    good = F.filter("questions", lambda q: F.length(F.trim(q)) > 0)
    rows = records.select(key).join(questions.select(key, good.alias("q")), key).select(key, F.posexplode("q").alias("n", "chunk_text"))
    return rows.select(key, F.concat(F.lit("q"), "n").alias("chunk_index"), F.col("n").cast("long").alias("ord"), "chunk_text", F.lit("question").alias("chunk_type"))


def coverage(records: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """Records, those with questions, all questions, and the share covered (0 without records)."""
    both = records.select(key).join(questions.select(key, F.size("questions").alias("n")), key, "left")
    has = F.coalesce(F.col("n") > 0, F.lit(False))
    return both.agg(F.count("*").alias("records"), F.count_if(has).alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("questions"), F.round(F.coalesce(F.try_divide(F.count_if(has), F.count("*")), F.lit(0.0)), 6).alias("share"))


def chunk_lengths(chunks: DataFrame, key: str) -> DataFrame:
    """n, p50, p90 and the greatest number of words, where pXX is the value at index floor(n XX / 100).

    Lengths are counted first: what is summed in order is a row for each distinct length."""
    counts = chunks.select(tx.word_count(F.col("chunk_text")).alias("w")).groupBy("w").agg(F.count("*").alias("c"))
    order = Window.orderBy("w")
    run = counts.select("w", F.sum("c").over(order).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("w")))
    return run.agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("w").alias("most"))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done, key, "left_anti")


def batch_ids(work: DataFrame, key: str) -> DataFrame:
    """Request ids r0, r1, ... in the order of the key.

    Numbered in ranges of the key and shifted by the sizes of the ranges before, not in one task."""
    n = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = work.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.expr("_at & 8589934591")
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("request_id", F.concat(F.lit("r"), (F.col("_before") + place).cast("string"))).drop("_at", "_part", "_before")


def gold_and_sample(records: DataFrame, gold: list, key: str, n: int, seed: int = 7) -> DataFrame:
    """The gold records and n others, chosen by a seeded digest of the key, which any engine can repeat."""
    is_gold = F.col(key).isin(gold)
    rest = records.where(~is_gold).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
    return records.where(is_gold).unionByName(rest)
