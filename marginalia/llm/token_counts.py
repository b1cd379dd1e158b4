"""Token counts by a map-side lookup in two tiers.

The first tier is a compact table of the most frequent pre-tokens of the whole corpus and their numbers
of tokens, which is broadcast; its size is a parameter.  The second is a cache in each worker, where what
isn't in the table is encoded once and kept while it is used.

Nothing of a text is shuffled.  For the table every task counts its own pre-tokens and sends a short list
to the driver, which adds the lists up; the length of a list and the number of tasks are both bounded.  The table only saves work: counts are the library's with any table.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import Encoded, Tokenizer, spelled, worker
from .textwords import as_bytes, slices


#: Tasks that count for the table, and what each sends to the driver: no more than 8 million entries in all.
COUNTING_TASKS, SENT = 4096, 2048


def frequent_pretokens(docs: DataFrame, tokenizer_path: str, size: int) -> list[str]:
    """The `size` most frequent pre-tokens of all texts.  Each task counts pieces with a bounded table (when
    it is four times too large, the rarer ones go), cuts them into pre-tokens, and sends its largest counts."""
    texts = common.documents(docs).select("text").coalesce(COUNTING_TASKS)

    def count(batches):
        tokenizer = worker(("cut", tokenizer_path), lambda: Tokenizer(tokenizer_path, True))
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(tokenizer.cut(text) or ())
                    if len(counts) > 16 * size:
                        counts = Counter(dict(heapq.nlargest(4 * size, counts.items(), key=lambda x: x[1])))
        words: Counter = Counter()
        for piece, n in counts.items():
            if len(piece) < 64:
                for word in tokenizer.pretokens(spelled(piece)):
                    words[word] += n
        top = [(p, n) for p, n in heapq.nlargest(SENT, words.items(), key=lambda x: (x[1], x[0])) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])

    counted = texts.mapInArrow(count, "pretoken string, n long").toArrow()
    total = counted.group_by("pretoken").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("pretoken", "ascending")])
    return total.column("pretoken").slice(0, size).to_pylist()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, frequent: int = 8192) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document.

    A null text counts as empty: no bytes, no tokens.  Repeated rows and null ids give a row each, and
    columns other than doc_id and text are ignored.  Texts of any length are encoded whole; long ones are
    taken one at a time.  Empty tables give no row.  Without frequent pre-tokens the counts are the same, and
    one pass over the texts less is made for more work in the caches."""
    spark: SparkSession = docs.sparkSession
    tokenizer = Tokenizer(tokenizer_path)
    key, plain = uuid.uuid4().hex, tokenizer.plain
    # tokenizers that don't cut as assumed go through the library, where the table is of no use
    words = frequent_pretokens(docs, tokenizer_path, frequent) if tokenizer.plain and frequent else []
    table = spark.sparkContext.broadcast({w: len(tokenizer.model(w)) for w in words})

    def count(batches):
        def make():
            return Encoded(Tokenizer(tokenizer_path, plain), len, sum, table.value)

        encoded = worker(("lengths", tokenizer_path, key), make)
        for batch in batches:
            for i, j in slices(as_bytes(batch.column(1))[0]):
                part = batch.slice(i, j - i)
                texts = [t or "" for t in part.column(1).to_pylist()]
                sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(encoded.texts(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = common.documents(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
