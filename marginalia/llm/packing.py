"""Packing documents into batches of a token budget, by optimal length buckets.

All documents are counted by padded length.  Over that histogram dynamic programming chooses at most
`buckets` boundaries that make the padding of the whole corpus least: every document is padded to the
boundary above it.  Inside a bucket, documents in the order of their ids fill batches one after
another; a batch holds as many as the budget allows at the bucket's length (at least one).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The boundaries of least padding: of equally good ones those with fewer buckets, then those
    whose last cut is the smallest.  lengths ascend.

    best[j] is the least padding of the first j + 1 lengths in so many buckets.  The cost of a bucket
    fulfils the quadrangle inequality, so the best cuts ascend with j, and each layer is found by
    halving the range of cuts: buckets x n log n steps."""
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    size = np.concatenate(([0], np.cumsum(counts)))
    total = np.concatenate(([0], np.cumsum(counts * lengths)))

    def cost(i, j):  # lengths i to j in one bucket
        return lengths[j] * (size[j + 1] - size[i]) - (total[j + 1] - total[i])

    best = cost(np.zeros(n, np.int64), np.arange(n))
    cuts: list[np.ndarray] = []
    ends = [int(best[-1])]
    for _ in range(1, min(buckets, n)):
        layer, cut = np.full(n, np.iinfo(np.int64).max // 2), np.zeros(n, np.int64)
        todo = [(len(cuts) + 1, n - 1, len(cuts), n - 1)]
        while todo:
            low, high, first, last = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(first, min(last, j - 1) + 1)  # the last length of the buckets before
            value = best[i] + cost(i + 1, j)
            k = int(value.argmin())
            layer[j], cut[j] = value[k], i[k]
            todo += [(low, j - 1, first, int(i[k])), (j + 1, high, int(i[k]), last)]
        cuts.append(cut)
        best = layer
        ends.append(int(best[-1]))
    k, j = int(np.argmin(ends)), n - 1
    out = [int(lengths[j])]
    for cut in reversed(cuts[:k]):
        j = int(cut[j])
        out.append(int(lengths[j]))
    return out[::-1]


def packed(docs: DataFrame, buckets: int = 16, budget: int = 16_384, granule: int = 8, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket_length, batch_no (from 0 in each bucket) and slot (from 0 in each batch)
    of every document.  length is the number of tokens; words of the text if it isn't given.

    Lengths are padded to a multiple of granule.  Null and empty texts have no token and take the
    shortest place; a text longer than the budget has a batch to itself.  Null ids come first, equal ids
    by length; repeated rows have a place each.  Empty tables give no row.  Other columns are ignored.

    Texts are never shuffled.  A bucket isn't numbered in one task: a range partitioning puts its rows
    in order over many tasks, each numbers its own, and the sums of the tasks before are added."""
    spark = docs.sparkSession
    tokens = F.coalesce((word_count(F.col("text").cast("string")) if length is None else length).cast("long"), F.lit(0))
    padded = F.ceil(F.greatest("n_tokens", F.lit(1)) / granule).cast("long") * granule
    sized = common.staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("n_tokens")).withColumn("padded", padded), "lengths")
    histogram = sized.groupBy("padded").agg(F.count("*").alias("n")).orderBy("padded").collect()
    cuts = boundaries(np.array([r.padded for r in histogram]), np.array([r.n for r in histogram]), buckets)
    bucket = F.element_at(F.filter(F.array(*map(F.lit, cuts or [granule])), lambda b: b >= F.col("padded")), 1).cast("long")

    def number(batches):
        from pyspark import TaskContext

        task, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            bucket = batch.column("bucket_length").to_numpy()
            place = np.zeros(len(bucket), np.int64)
            for b in np.unique(bucket):
                own = np.flatnonzero(bucket == b)
                place[own] = counts.get(b, 0) + np.arange(len(own))
                counts[b] = counts.get(b, 0) + len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(np.full(len(bucket), task, np.int32))], ["doc_id", "n_tokens", "bucket_length", "place", "task"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = sized.select("doc_id", "n_tokens", bucket.alias("bucket_length")).repartitionByRange(n, "doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens")
    numbered = common.staged(placed.mapInArrow(number, "doc_id long, n_tokens long, bucket_length long, place long, task int"), "places")
    before = Window.partitionBy("bucket_length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy("bucket_length", "task").agg(F.count("*").alias("rows"))  # a row for each task and bucket
    offsets = counts.select("bucket_length", "task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    at = F.expr("place + offset")
    each = F.expr(f"greatest(1, {budget} div bucket_length)")
    return numbered.join(offsets, ["bucket_length", "task"]).select("doc_id", "n_tokens", "bucket_length", F.floor(at / each).cast("long").alias("batch_no"), (at % each).alias("slot"))
