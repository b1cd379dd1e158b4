"""Calls of models from outside: committed as they are done, several at once, and never paid twice."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from marginalia import plugins


def records(spark, n):
    return spark.createDataFrame([(i, f"text {i}") for i in range(n)], "id long, text string").repartition(3)


def calls(folder):
    """How often each prompt was sent: a file for every call."""
    found = {}
    for name in os.listdir(folder):
        prompt = name.rsplit("-", 1)[0]
        found[prompt] = found.get(prompt, 0) + 1
    return found


def noted(folder, prompt):
    open(f"{folder}/{prompt}-{time.time_ns()}{threading.get_ident()}", "w").close()


def test_a_killed_run_loses_one_batch_at_most(spark, tmp_path):
    log, mark = tmp_path / "calls", tmp_path / "killed"
    log.mkdir()
    folder = str(tmp_path / "out")
    n, batch = 60, 10

    def complete(prompt):
        noted(log, prompt)
        # the worker dies in the fourth batch of the first run
        if len(os.listdir(log)) > 35 and not mark.exists():
            mark.touch()
            os._exit(1)
        return prompt.upper()

    docs = records(spark, n)
    with pytest.raises(Exception):  # noqa: B017, PT011  Spark's own class
        plugins.generated_to(folder, docs, complete, F.col("text"), "id", batch_rows=batch, at_once=2)
    status = plugins.generation_status(folder, docs, "id").first()
    assert (status.records, status.failed) == (n, 0) and 20 <= status.done < n and status.done + status.pending == n
    before = calls(log)
    committed = {r.raw.lower() for r in spark.read.option("basePath", folder).parquet(folder).where("error is null").collect()}
    assert len(committed) == status.done

    done = plugins.generated_to(folder, docs, complete, F.col("text"), "id", batch_rows=batch, at_once=2)
    assert {(r.id, r.raw) for r in done.collect()} == {(i, f"TEXT {i}") for i in range(n)}
    after = calls(log)
    # what was committed wasn't asked again; of the rest only the batch that broke was asked twice
    assert all(after[p] == 1 for p in committed)
    assert sum(after.values()) - sum(before.values()) == n - status.done
    assert sum(v - 1 for v in after.values()) <= batch

    again = plugins.generated_to(folder, docs, complete, F.col("text"), "id")
    assert again.count() == n and calls(log) == after


def test_errors_are_taken_up_again_and_no_answer_is_a_result(spark, tmp_path):
    folder, broken = str(tmp_path / "out"), tmp_path / "broken"
    broken.touch()

    def complete(prompt):
        if broken.exists() and prompt.endswith(("1", "3")):
            raise plugins.Unavailable("no credit")
        return None if prompt.endswith("2") else "yes"

    docs = records(spark, 5)
    first = plugins.generated_to(folder, docs, complete, F.col("text"), "id")
    assert {(r.id, r.raw) for r in first.collect()} == {(0, "yes"), (2, None), (4, "yes")}
    status = plugins.generation_status(folder, docs, "id").first()
    assert tuple(status) == (5, 3, 2, 0)
    broken.unlink()
    second = plugins.generated_to(folder, docs, complete, F.col("text"), "id")
    assert {(r.id, r.raw) for r in second.collect()} == {(0, "yes"), (1, "yes"), (2, None), (3, "yes"), (4, "yes")}


def test_a_task_has_several_calls_under_way(spark):
    def complete(prompt):
        time.sleep(0.3)
        return str(threading.active_count())

    began = time.time()
    rows = plugins.generated(records(spark, 32).coalesce(1), complete, F.col("text"), "id", at_once=8).collect()
    assert len(rows) == 32 and time.time() - began < 32 * 0.3 * 0.7


def test_no_records(spark, tmp_path):
    assert plugins.generated_to(str(tmp_path / "out"), records(spark, 1).where("false"), str.upper, F.col("text"), "id").collect() == []


def test_a_judge_is_asked_once_and_may_say_refused(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    rows = spark.createDataFrame([(q, "cats", r, f"text {r}", 10 - r) for q in (1, 2, 3) for r in (1, 2)], "q int, question string, rank long, text string, n_words int")

    def complete(prompt, most):
        noted(log, "asked")
        return "refused", {}

    verdicts = plugins.judged(rows, "q", "question", complete, folder=str(tmp_path / "judged"))
    # the word refused is a reply that can't be read, not a refusal
    assert [(v.answers, v.degraded) for v in verdicts.collect()] == [(None, True)] * 6
    assert verdicts.where("degraded").count() == 6 and calls(log) == {"asked": 3}
    plugins.judged(rows, "q", "question", complete, folder=str(tmp_path / "judged")).count()
    assert calls(log) == {"asked": 3}
