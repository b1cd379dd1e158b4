"""Stated queries against all vectors, against every pair; no pair is a row of a join or a shuffle."""

import random

import pytest

import __spark_entry__ as entry
from marginalia.operators import vectors


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    known = [[float(rng.randint(-3, 3)) for _ in range(4)] for _ in range(40)]  # many equal scores
    rows = [(i, rng.choice(known), rng.choice([0, 1, 2, None])) for i in range(300)] + [(300, None, 1), (301, [1.0, None, 0.0, 1.0], 1), (302, [1.0, 2.0], 2), (303, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>, label int").repartition(3)
    return {i: (v, label) for i, v, label in rows[:300]}, df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), df


def ranking(rows, q):
    return sorted((-round(sum(a * b for a, b in zip(v, rows[q][0])), 6), i) for i, (v, _) in rows.items() if i != q)


@pytest.mark.parametrize("most", [4096, 4])
def test_equal_to_every_pair(monkeypatch, tables, most):
    monkeypatch.setattr(vectors, "MOST_QUERIES", most)
    monkeypatch.setattr(vectors, "MOST_SCORES", 100)  # small blocks of scores
    rows, asked, df = tables
    queries = range(0, 300, 20)
    got = sorted(tuple(r) for r in vectors.nearest(asked, df, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == [(q, n, i, -s) for q in queries for n, (s, i) in enumerate(ranking(rows, q)[:5], 1)]

    first = {r.query_id: r.first for r in vectors.first_relevant(asked, df).collect()}
    assert first == {q: next((n for n, (_, i) in enumerate(ranking(rows, q), 1) if rows[i][1] is not None and rows[i][1] == rows[q][1]), None) for q in queries}

    parts = df.selectExpr("vec_id", "vector", "vec_id div 7 as record", "vec_id % 7 as part")
    want = {}
    for q in queries:
        for s, i in ranking(rows, q):
            want.setdefault((q, i // 7), (-s, i % 7))
    assert {(r.query_id, r.record): (r.score, r.part) for r in vectors.best_parts(asked, parts).collect()} == want

    kinds = df.selectExpr("vec_id", "vector", "if(vec_id % 2 = 0, 'even', 'odd') as kind")
    want = {}
    for q in queries:
        for s, i in ranking(rows, q):
            want.setdefault((q, "odd" if i % 2 else "even"), -s)
    assert {(r.query_id, r.kind): r.score for r in vectors.greatest(asked, kinds).collect()} == want


def test_without_queries_or_vectors(tables):
    _, asked, df = tables
    for a, v in ((asked.limit(0), df), (asked, df.limit(0))):
        assert vectors.nearest(a, v, 5).count() == vectors.first_relevant(a, v).count() == 0


@pytest.mark.parametrize("name", ["vector_cosine_topk", "best_chunk_per_doc", "eval_cases", "eval_summary", "eval_recall_at_k", "gold_gain"])
def test_pairs_are_no_rows_of_a_plan(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "lambdafunction" not in plan
