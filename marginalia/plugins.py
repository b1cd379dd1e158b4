"""What calls models from outside: encoders, rerankers, judges and generators are plain callables, and
those here are deterministic ones that need nothing outside."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules
from .functions import text as tx
from .shared import new_folder, staged

REFUSAL = "I couldn't find a passage that answers this."
#: Characters of a text that go into a prompt: for a judge, and for a generator of questions.
JUDGED_CHARS, READ_CHARS = 700, 4000


class Unavailable(Exception):
    """A model couldn't be asked: that isn't the answer no."""


def hashed_encoder(size: int = 64, column: str = "text") -> Callable[[DataFrame], DataFrame]:
    """An encoder for tests and fallback: words hashed into `size` signed cells, of unit length."""

    def encode(df: DataFrame) -> DataFrame:
        terms = tx.tokens(F.col(column))
        cell = lambda i: F.aggregate(F.filter(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(size)) == i), F.lit(0.0), lambda s, t: s + F.when(F.xxhash64(t, F.lit(1)) > 0, 1.0).otherwise(-1.0))
        raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), cell)
        norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x * x))
        return df.withColumn("_raw", raw).withColumn("vector", F.transform("_raw", lambda x: x / F.when(norm > 0, norm).otherwise(1.0))).drop("_raw")

    return encode


def letter_encoder(column: str = "text") -> Callable[[DataFrame], DataFrame]:
    """An encoder for tests that any engine can repeat: how often each letter from a to z occurs, of unit length."""

    @F.arrow_udf("array<double>")
    def letters(low: pa.Array) -> pa.Array:
        out = [np.zeros((0, 26))]
        for at in range(0, len(low), 2048):
            some = low[at : at + 2048].cast(pa.large_binary())
            ends = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
            counts = np.zeros((len(some), 26))
            for i in range(0, len(some), 256):
                bounds = ends[i : i + 257]
                own = np.frombuffer(some.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                on = (own >= 97) & (own <= 122)
                counts[i : i + 256] = np.bincount(row[on] * 26 + (own[on] - 97), minlength=(len(bounds) - 1) * 26).reshape(-1, 26)
            norm = np.sqrt((counts * counts).sum(1))
            out.append(counts / np.where(norm > 0, norm, 1.0)[:, None])
        flat = np.concatenate(out)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * 26, pa.int32()), pa.array(flat.ravel()))

    # bytes from a to z are those letters in UTF-8 alone
    return lambda df: df.withColumn("vector", letters(F.lower(F.coalesce(F.col(column), F.lit("")))))


def overlap_scorer(query: Column, text: Column) -> Column:
    """A reranker's score: the share of the query's words that the text has."""
    q = F.array_distinct(tx.tokens(query, tx.ASCII_TOKENS))
    return F.round(F.size(F.array_intersect(q, tx.tokens(text, tx.ASCII_TOKENS))) / F.greatest(F.size(q), F.lit(1)), 6)


#: Fixed value: calls of a model that a task has under way at once.
AT_ONCE = 8


def generated(records: DataFrame, complete: Callable[[str], str | None], prompt: Column, key: str, at_once: int = AT_ONCE) -> DataFrame:
    """key, raw, error for each record: `complete` is called once a record, in every task for `at_once` of them at a
    time, since a call waits for an answer from outside.  A call that raises is a row with its error; no answer (None) is a
    row with neither.  Nothing is kept: every action on the result calls again.  generated_to commits what is done."""

    def one(prompt: str) -> tuple[str | None, str | None]:
        try:
            return complete(prompt), None
        except Exception as e:  # noqa: BLE001  one failure is a result, not the end
            return None, str(e)

    def call(batches: Iterator[pd.DataFrame]):
        with ThreadPoolExecutor(at_once) as pool:
            for pdf in batches:
                for at in range(0, len(pdf), 16 * at_once):
                    part = pdf.iloc[at : at + 16 * at_once]
                    replies = list(pool.map(one, part["prompt"]))
                    yield pd.DataFrame({key: part[key].to_numpy(), "raw": [r for r, _ in replies], "error": [e for _, e in replies]})

    kind = dict(records.dtypes)[key]
    return records.select(key, prompt.alias("prompt")).mapInPandas(call, f"`{key}` {kind}, raw string, error string")


def _results(spark: SparkSession, folder: str, key: str, kind: str) -> DataFrame:
    schema = f"`{key}` {kind}, raw string, error string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/run=none/batch=0")
    return spark.read.schema(schema).option("basePath", folder).parquet(folder).select(key, "raw", "error")


def generated_to(folder: str, records: DataFrame, complete: Callable[[str], str | None], prompt: Column, key: str, batch_rows: int = 10_000, at_once: int = AT_ONCE) -> DataFrame:
    """Runs `complete` for the records that have no good result in folder, and returns all good results (key, raw; a null raw
    is a model that gave no answer).

    The work is written as files of at most batch_rows prompts and taken up as a stream of micro-batches, a file each, spread over the
    tasks.  A batch is committed as it ends, under the number of its run and its own, so one that Spark repeats replaces itself.
    A run that breaks loses the batch that it was in and no more: the next one calls only for what has no good
    result, errors included."""
    spark, kind = records.sparkSession, dict(records.dtypes)[key]
    done = _results(spark, folder, key, kind).where("error is null").select(key)
    work = f"{folder.rstrip('/')}-work-{uuid.uuid4().hex}"
    pending = staged(records.select(key, prompt.alias("prompt")).join(done, key, "left_anti"), "pending")
    n = pending.count()
    if n:
        pending.repartition(-(-n // batch_rows)).write.option("maxRecordsPerFile", batch_rows).parquet(f"{work}/prompts")
        run = f"{folder}/run={uuid.uuid4().hex}"
        tasks = max(1, spark.sparkContext.defaultParallelism)

        def commit(batch: DataFrame, number: int) -> None:
            generated(batch.repartition(tasks), complete, F.col("prompt"), key, at_once).write.mode("overwrite").parquet(f"{run}/batch={number}")

        stream = spark.readStream.schema(pending.schema).option("maxFilesPerTrigger", 1).parquet(f"{work}/prompts")
        stream.writeStream.foreachBatch(commit).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _results(spark, folder, key, kind).where("error is null").select(key, "raw")


def generation_status(folder: str, records: DataFrame, key: str) -> DataFrame:
    """One row: how many records there are, have a good result, only errors, and nothing yet."""
    results = _results(records.sparkSession, folder, key, dict(records.dtypes)[key])
    state = results.groupBy(key).agg(F.max(F.when(F.col("error").isNull(), 2).otherwise(1)).alias("_state"))
    both = records.select(key).join(state, key, "left")
    return both.agg(F.count("*").alias("records"), F.count_if(F.col("_state") == 2).alias("done"), F.count_if(F.col("_state") == 1).alias("failed"), F.count_if(F.col("_state").isNull()).alias("pending"))


def question_prompt(collection: Column, book: Column, text: Column, n: int = 6) -> Column:
    """What a generator is asked about a record."""
    return F.concat(F.lit(f"Write {n} questions that this text answers, as a JSON array of strings.\n\n("), F.coalesce(collection, F.lit("?")), F.lit(", "), F.coalesce(book, F.lit("?")), F.lit(")\n"), F.substring(tx.collapsed(text), 1, READ_CHARS))


def judge_prompts(candidates: DataFrame, question_key: str, question: str, text: str = "text", k: int = 10) -> DataFrame:
    """question_key, prompt and n for the first k candidates of each question, in their order."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.substring(tx.collapsed(F.col(text)), 1, JUDGED_CHARS))
    lines = F.array_sort(F.collect_list(F.struct("rank", block.alias("line"))))
    found = candidates.where(F.col("rank") <= k).groupBy(question_key).agg(F.first(question).alias("_q"), lines.alias("_l"))
    ask = F.concat(F.lit("Which of the passages answer the question? Return a JSON array with n, answers and why for each.\n\nQuestion: "), F.col("_q"), F.lit("\n\n"), F.array_join(F.transform("_l", lambda x: x.line), "\n\n"))
    return found.select(question_key, ask.alias("prompt"), F.size("_l").alias("n"))


def judged(candidates: DataFrame, question_key: str, question: str, complete: Callable[[str, int], tuple[str | None, dict]], text: str = "text", k: int = 10, folder: str | None = None) -> DataFrame:
    """question_key, rank, answers, why and degraded for the first k candidates of each question.

    complete(prompt, max_tokens) returns a reply and its usage.  No reply is a refusal: nothing answers.  Where it
    raises, or the reply can't be read, `degraded` is true and answers null: nobody looked.  Replies are written to folder
    (a new one if none is given), so a judge is asked once a question however often the result is read, and a folder that
    has replies from before isn't asked for them again."""

    def call(prompt: str) -> str | None:
        return complete(prompt, 600)[0]

    asked = staged(judge_prompts(candidates, question_key, question, text, k), "asked")
    folder = folder or new_folder(candidates.sparkSession, "judged")
    good = generated_to(folder, asked, call, F.col("prompt"), question_key).withColumn("asked", F.lit(True))
    replies = asked.select(question_key, "n").join(good, question_key, "left")
    verdicts = rules.parsed_verdicts(F.col("raw"), F.col("n"))
    refused = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.lit(False).alias("answers"), F.lit("refused").alias("why")))
    unread = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.struct(F.lit(None).cast("boolean").alias("answers"), F.lit(None).cast("string").alias("why")))
    read = replies.withColumn("v", F.when(F.col("asked") & F.col("raw").isNull(), refused).otherwise(verdicts))
    rows = read.withColumn("degraded", F.col("v").isNull()).withColumn("v", F.coalesce("v", unread))
    return rows.select(question_key, "degraded", F.posexplode("v").alias("at", "v")).select(question_key, (F.col("at") + 1).cast("long").alias("rank"), "v.answers", "v.why", "degraded")


def overlap_judge(prompt: str, max_tokens: int) -> tuple[str, dict]:
    """A judge for tests: a passage answers if it has half of the question's words."""
    import json
    import re

    words = lambda t: set(re.findall("[a-z0-9]{2,}", t.lower()))
    asked, *blocks = re.split(r"\n\n(?=\[[0-9]+\] )", prompt.split("Question: ", 1)[1])
    mine = words(asked)
    verdicts = [{"n": i, "answers": 2 * len(mine & words(b.split("] ", 1)[1])) >= len(mine), "why": "words"} for i, b in enumerate(blocks, 1)]
    return json.dumps(verdicts), {"tokens_in": len(prompt) // 4, "tokens_out": 10 * len(blocks)}


def answer_prompts(candidates: DataFrame, question_key: str, question: str, text: str = "chunk_text", citation: str = "citation") -> DataFrame:
    """question_key, prompt, citations: confident candidates alone reach the prompt; a question without
    any has the refusal and no prompt."""
    good = F.col("confident")
    lines = F.array_sort(F.collect_list(F.when(good, F.struct("rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col(text)).alias("line"), F.col(citation).alias("cite")))))
    found = candidates.groupBy(question_key).agg(F.first(question).alias("_q"), lines.alias("_l"))
    prompt = F.concat(F.lit("Answer from the passages alone.\n\n"), F.array_join(F.transform("_l", lambda x: x.line), "\n"), F.lit("\n\nQuestion: "), F.col("_q"))
    has = F.size("_l") > 0
    return found.select(question_key, F.when(has, prompt).alias("prompt"), F.transform("_l", lambda x: x.cite).alias("citations"), F.when(~has, F.lit(REFUSAL)).alias("refusal"))
