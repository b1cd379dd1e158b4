"""Counts, weights and rankings where only a few terms are sent to tasks and tasks begin anew often."""

import math
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import topk
from marginalia.shared import staged

from .test_topk import every_pair, texts


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(topk, "MOST_SENT", 6)
    monkeypatch.setattr(topk.Terms, "MOST", 8)
    monkeypatch.setattr(topk.Terms, "MOST_CUT", 8)


def test_words_that_are_kept_are_bounded(monkeypatch):
    """Few substrings but many words: a word's substrings were kept for as long as the task ran."""
    monkeypatch.setattr(topk.Terms, "MOST_CUT", 100)
    terms = topk.Terms((3, 5))
    for i in range(200):
        terms.counts(pa.array([[f" {'ab' * (i + 3)} "]]))
        if terms.full:
            terms.clear()
    assert len(terms.cut) <= 101


def test_weights_with_few_terms_sent(spark, small):
    docs = texts(11, 200) + [(1000, ""), (1001, "once")]
    own = {i: Counter(t.split()) for i, t in docs}
    df = Counter(t for c in own.values() for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items()}
    norm = {i: math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for i, c in own.items()}
    counted = staged(topk.document_words(spark.createDataFrame(docs, "doc long, text string"), "doc", tx.words(F.col("text"))), "counted")
    terms = staged(topk.vocabulary(counted, len(docs)), "terms")
    assert {r.term: r.df for r in terms.collect()} == df
    got = {(r.doc, r.term): r.weight for r in topk.weighted(counted, terms).collect()}
    assert got == pytest.approx({(i, t): n * idf[t] / norm[i] for i, c in own.items() for t, n in c.items()})


@pytest.mark.parametrize("grams", [None, (3, 5)])
def test_rankings_with_few_terms_sent(spark, small, grams):
    docs, asked = texts(12, 150), texts(13, 8)
    split = tx.padded_words(F.col("text")) if grams else tx.words(F.col("text"))
    counted = staged(topk.document_words(spark.createDataFrame(docs, "doc long, text string"), "doc", split), "counted")
    terms = staged(topk.vocabulary(counted, len(docs), 2, None, grams), "terms")
    a = staged(topk.document_words(spark.createDataFrame(asked, "q long, text string"), "q", split), "asked")
    got = {(r.q, r.doc, r["rank"]) for r in topk.top_documents(a, counted, terms, 4, sublinear=bool(grams), grams=grams).collect()}
    assert got == {x[:2] + x[3:] for x in every_pair(asked, docs, 4, grams, 2, sublinear=bool(grams))}
