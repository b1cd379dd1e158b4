"""Fusion of complete rankings by the best part, against rankings of every pair of a question and a part."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import plugins
from marginalia.operators import parts, search, topk
from marginalia.plans import retrieval

from .test_topk import every_pair


def whole(records, asked, characters):
    """The ten best of each question, from complete rankings."""
    chunks = [(i * 100 + j, t) for i, own in records for j, t in enumerate(own)]

    def best(scores):
        out = {}
        for q, _ in asked:
            own = {}
            for n, _ in chunks:
                own[n // 100] = max(own.get(n // 100, (-9.0, 0)), (scores.get((q, n), 0.0), -n))
            out[q] = {i: (rank, s, -n) for rank, (i, (s, n)) in enumerate(sorted(own.items(), key=lambda x: (-x[1][0], x[0])), 1)}
        return out

    word = best({x[:2]: x[2] for x in every_pair(asked, chunks, len(chunks))})
    char = best({x[:2]: x[2] for x in every_pair(asked, chunks, len(chunks), (3, 5), 2, 300_000, sublinear=True)})

    def letters(text):
        v = np.array([text.lower().count(chr(97 + i)) for i in range(26)], float)
        return v / (math.sqrt(v @ v) or 1.0)

    vector = best({(q, n): round(float(letters(a) @ letters(t)), 6) for q, a in asked for n, t in chunks})
    text = dict(chunks)
    found = set()
    for q, _ in asked:
        fused = {i: round(1 / (60 + word[q][i][0]) + 1 / (60 + vector[q][i][0]) + (0.5 / (60 + char[q][i][0]) if characters else 0), 8) for i, _ in records}
        for rank, (i, s) in enumerate(sorted(fused.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
            found.add((q, i, rank, f"{s:.8f}", f"{vector[q][i][1]:.6f}", text[vector[q][i][2]]))
    return found


@pytest.mark.parametrize("characters,small", [(True, False), (False, True)])
def test_fused_answers_are_those_of_complete_rankings(spark, monkeypatch, characters, small):
    """Rankings had a row for each question and part, with its text: at 0.1 GB they ended neither in time nor on the disk.  With small
    sizes a document has parts in several products, most terms come by a join, and questions go in blocks."""
    if small:
        monkeypatch.setattr(parts, "SLICE", 3)
        monkeypatch.setattr(parts, "MOST_QUESTIONS", 3)
        monkeypatch.setattr(topk, "MOST_SENT", 5)
        monkeypatch.setattr(topk.Terms, "MOST", 8)
    monkeypatch.setattr(parts.Asked, "MANY", 3)
    monkeypatch.setattr(parts.Asked, "COLUMNS", 6)
    monkeypatch.setattr(search, "complete", None)
    rng = random.Random(3)
    words = [f"{a}{b}x" for a in "bcdfg" for b in "aeiou"]
    say = lambda n: " ".join(rng.choices(words, [1 / (j + 1) for j in range(25)], k=n))
    records = [(i, [say(rng.randint(4, 9)) for _ in range(rng.randint(1, 6))]) for i in range(1, 60)] + [(60, [""])]
    asked = [(q, say(6)) for q in range(1, 8)] + [(8, "nothing of it")]
    # questions are parts that are used as they are
    rows = spark.createDataFrame([(i, own[0]) for i, own in records], "id long, text string")
    more = spark.createDataFrame([(i, own[1:]) for i, own in records if own[1:]], "id long, questions array<string>")
    options = retrieval.Options(exclude_notes=False, use_characters=characters)
    index = retrieval.build(rows, "id", more, plugins.letter_encoder(), options)
    found = retrieval.answers(index, spark.createDataFrame(asked, "question_id long, text string"), "id", plugins.letter_encoder(), options)
    got = {(r.question_id, r.id, r["rank"], f"{r.score:.8f}", f"{r.vector_score:.6f}", r.chunk_text) for r in found.collect()}
    assert got == whole(records, asked, characters)


def test_the_first_of_equal_parts_and_parts_without_a_vector(spark):
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "q string, vector array<double>")
    docs = spark.createDataFrame([(1, [[0.6, 0.8], None, [0.6, -0.8]]), (2, [[-1.0, 0.0]]), (3, [[-1.0, 0.0], None])], "doc long, vectors array<array<double>>")
    ranking = parts.scored_vectors(asked, docs)
    found = ranking.best_parts(ranking.first_again(5)).orderBy("rank")
    assert [(r.doc, r.score, r.part) for r in found.collect()] == [(1, 0.6, 0), (3, 0.0, 1), (2, -1.0, 0)]
    assert found.where(F.col("q") != "q").count() == 0
