"""Matches of two sources where the terms of the left one alone are a table."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.operators import align, topk
from marginalia.operators import postings as ps


def told(rng, n):
    words = rng.choices([f"w{i}" for i in range(40)], [1 / (j + 1) for j in range(40)], k=n)
    return [*words, *(" ".join(x) for x in zip(words, words[1:]))]


@pytest.mark.parametrize("kind,most", [("int", None), ("long", 3), ("string", None)])
def test_best_matches_are_those_of_every_pair(spark, monkeypatch, kind, most):
    """All counts of all pairs of words were a table that was joined by the term; that isn't asked for any more."""
    monkeypatch.setattr(ps, "vocabulary", None)
    if most:
        monkeypatch.setattr(topk.Terms, "MOST", 8)
    rng = random.Random(9)
    right = {(f"r{i:03d}" if kind == "string" else i): told(rng, rng.randint(0, 40)) for i in range(150)}
    left = {i: told(rng, rng.randint(1, 12)) for i in range(12)} | {12: ["other"], 13: []}
    left[14] = right["r077" if kind == "string" else 77]
    df = Counter(t for ts in right.values() for t in set(ts))
    idf = {t: math.log((1 + len(right)) / (1 + n)) + 1 for t, n in df.items()}
    unit = lambda ts: (lambda c: {t: w / math.sqrt(sum(x * x for x in c.values())) for t, w in c.items()})({t: n * idf[t] for t, n in Counter(ts).items() if t in idf})
    rights = {i: unit(ts) for i, ts in right.items()}
    want = {}
    for i, ts in left.items():
        q = unit(ts)
        s, r = min((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 6), r) for r, v in rights.items())
        want[i] = (r, -s)
    a = spark.createDataFrame(list(left.items()), "l int, terms array<string>")
    b = spark.createDataFrame(list(right.items()), f"r {kind}, terms array<string>").repartition(3)
    got = {x.l: (x.r, x.similarity) for x in align.best_matches(a, b, "l", "r").collect()}
    assert got == want
    assert b.where(F.size("terms") == 0).count() > 0
