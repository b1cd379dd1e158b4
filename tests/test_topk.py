"""The k best documents by blocks with bounds, against scoring every pair."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as tx
from marginalia.operators import topk
from marginalia.shared import staged


def texts(seed, n, words=30, length=40):
    random.seed(seed)
    known = [f"w{i}" for i in range(words)] + ["été", "日本"]
    return [(i, " ".join(random.choices(known, [1 / (j + 1) for j in range(len(known))], k=random.randint(0, length)))) for i in range(n)]


def terms_of(text, grams):
    words = text.split()
    if not grams:
        return Counter(words)
    return Counter(w[i : i + n] for w in (f" {x} " for x in words) for n in range(grams[0], grams[1] + 1) for i in range(len(w) - n + 1))


def every_pair(asked, docs, k, grams=None, min_df=1, most=None, sublinear=False):
    own = {i: terms_of(t, grams) for i, t in docs}
    df, cf = Counter(t for c in own.values() for t in c), sum(own.values(), Counter())
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-cf[t], t.encode()))[:most]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    tf = (lambda n: 1 + math.log(n)) if sublinear else float

    def vector(counts):
        raw = {t: tf(n) * idf[t] for t, n in counts.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    vectors = {i: vector(c) for i, c in own.items()}
    out = set()
    for q, t in asked:
        mine = vector(terms_of(t, grams))
        scored = sorted((-round(sum(w * v[x] for x, w in mine.items() if x in v), 6), i) for i, v in vectors.items() if mine.keys() & v.keys())
        out |= {(q, i, -s, rank) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("options", [{}, {"grams": (3, 5), "min_df": 2, "most": 40, "sublinear": True}])
@pytest.mark.parametrize("small", [True, False])
def test_equal_to_every_pair(spark, monkeypatch, options, small):
    if not small:  # a large vocabulary is joined, and questions go in several blocks
        monkeypatch.setattr(topk, "few", lambda df: False)
    docs, asked = texts(1, 300) + [(1000, ""), (1001, "w0"), (1002, "w0")], texts(2, 12) + [(99, ""), (98, "nowhere")]
    grams = options.get("grams")
    split = tx.padded_words(F.col("text")) if grams else tx.words(F.col("text"))
    d = spark.createDataFrame(docs, "doc int, text string").repartition(5)
    counted = staged(topk.document_words(d, "doc", split), "counted")
    vocabulary = staged(topk.vocabulary(counted, len(docs), options.get("min_df", 1), options.get("most"), grams), "vocabulary")
    a = staged(topk.document_words(spark.createDataFrame(asked, "q string, text string"), "q", split), "asked")
    found = topk.top_documents(a, counted, vocabulary, 4, sublinear=bool(grams), grams=grams, most_terms=10 if not small else 1 << 20)
    want = every_pair([(str(q), t) for q, t in asked], docs, 4, grams, options.get("min_df", 1), options.get("most"), bool(grams))
    got = {(r.q, r.doc, r.score, r["rank"]) for r in found.collect()}
    assert {x[:2] + x[3:] for x in got} == {x[:2] + x[3:] for x in want}
    assert sorted(x[2] for x in got) == pytest.approx(sorted(x[2] for x in want), abs=2e-6)


def test_few_pairs_are_scored(spark):
    """With bounds only a small part of the pairs that share a term is scored."""
    rng = np.random.default_rng(3)
    n, terms = 20_000, 500
    # common terms weigh little, rare ones much
    share = 1 / np.arange(1, terms + 1)
    doc, term = np.nonzero(rng.random((n, terms)) < share)
    idf = np.log(n / np.bincount(term, minlength=terms).clip(1)) + 1
    weight = idf[term] / np.sqrt(np.bincount(doc, weights=idf[term] ** 2, minlength=n))[doc]
    question = np.repeat(np.arange(10), 12)
    asked = np.concatenate((rng.choice(20, (10, 6)), rng.choice(terms, (10, 6))), axis=1)
    questions = topk.Questions(list(range(10)), [str(i) for i in range(terms)], question, asked.ravel(), idf[asked.ravel()])
    best = topk.Best(10, 3)
    for at in range(0, n, 1000):
        own = (doc >= at) & (doc < at + 1000)
        topk.score_block(questions, best, np.arange(at, at + 1000), doc[own] - at, term[own], weight[own])
    dense = np.zeros((n, terms))
    dense[doc, term] = weight
    shared = 0
    for i in range(10):
        q = np.bincount(asked[i], weights=idf[asked[i]], minlength=terms)
        scores = np.round(dense @ q, topk.DIGITS)
        order = np.lexsort((np.arange(n), -scores))[:3]
        assert best.docs[i].tolist() == order.tolist() and best.scores[i] == pytest.approx(scores[order], abs=2e-6)
        shared += int((dense[:, asked[i]] > 0).any(axis=1).sum())
    assert best.pairs * 4 < shared


def test_most_frequent_takes_ties_by_the_term(spark):
    rows = spark.createDataFrame([(f"t{i:02}", 5 if i < 3 else 2) for i in range(20)][::-1], "term string, cf long")
    assert {r.term for r in topk.most_frequent(rows, 5).collect()} == {"t00", "t01", "t02", "t03", "t04"}
    assert topk.most_frequent(rows, 3).count() == 3 and topk.most_frequent(rows, 100).count() == 20


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc long, text string")
    counted = staged(topk.document_words(none, "doc", tx.words(F.col("text"))), "counted")
    vocabulary = staged(topk.vocabulary(counted, 0, 1, 10), "vocabulary")
    asked = staged(topk.document_words(spark.createDataFrame([(1, "a b")], "q long, text string"), "q", tx.words(F.col("text"))), "asked")
    assert topk.top_documents(asked, counted, vocabulary, 3).collect() == []


def test_fused_top_has_the_ranks_of_complete_rankings(spark):
    """Against complete rankings of all three lists; the first depth is too small, so it is doubled."""
    docs, asked = texts(5, 120), texts(6, 6)
    rng = random.Random(7)
    unit = lambda: (lambda v: [x / math.hypot(*v) for x in v])([rng.gauss(0, 1) for _ in range(4)])
    vectors = {i: unit() for i, _ in docs if i % 7}  # some documents have no vector
    asked_vectors = {q: unit() for q, _ in asked}

    def ranks(scored):
        return {i: rank for rank, (_, i) in enumerate(sorted((-s, i) for i, s in scored.items()), 1)}

    def complete(grams, **kept):
        own = every_pair(asked, docs, len(docs), grams, **kept)
        return {q: {i: s for x, i, s, _ in own if x == q} for q, _ in asked}

    words, grams = complete(None), complete((3, 5), min_df=2, most=40, sublinear=True)
    want = {}
    for q, _ in asked:
        word = ranks({i: words[q].get(i, 0.0) for i, _ in docs})
        char = ranks(grams[q])
        vector = ranks({i: round(sum(a * b for a, b in zip(v, asked_vectors[q])), 6) for i, v in vectors.items()})
        fused = {i: round(1 / (60 + word[i]) + 1 / (60 + vector[i]) + 0.5 / (60 + char.get(i, len(docs))), 8) for i in vectors}
        want[q] = [i for _, i in sorted((-s, i) for i, s in fused.items())[:5]]

    d = spark.createDataFrame(docs, "doc long, text string").repartition(4)
    a = spark.createDataFrame(asked, "q long, text string")

    def ranking(split, grams=None, **kept):
        counted = staged(topk.document_words(d, "doc", split), "counted")
        return topk.TextList(staged(topk.document_words(a, "q", split), "asked"), counted, staged(topk.vocabulary(counted, len(docs), grams=grams, **kept), "vocabulary"), bool(grams), grams)

    vector = topk.VectorList(spark.createDataFrame(list(asked_vectors.items()), "q long, vector array<double>"), spark.createDataFrame(list(vectors.items()), "doc long, vector array<double>"))
    found = topk.fused_top(ranking(tx.words(F.col("text"))), vector, ranking(tx.padded_words(F.col("text")), (3, 5), min_df=2, max_features=40), len(docs), 5, depth=4)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.q, []).append(r.doc)
    assert got == want


def test_written_postings_have_a_row_for_each_document(spark):
    """A row for each block of documents grew to many MB, of which readers and writers hold many at once."""
    docs, asked = texts(8, 200), texts(9, 5)
    split = tx.words(F.col("text"))
    counted = staged(topk.document_words(spark.createDataFrame(docs, "doc long, text string"), "doc", split), "counted")
    a = staged(topk.document_words(spark.createDataFrame(asked, "q long, text string"), "q", split), "asked")
    ranking = topk.TextList(a, counted, staged(topk.vocabulary(counted, len(docs)), "vocabulary"))
    rows, _ = ranking.postings
    assert rows.count() == len(docs) and rows.selectExpr("max(length(term))").first()[0] <= 4 * 32
    assert {tuple(r) for r in ranking.first_again(3).collect()} == {tuple(r) for r in ranking.first(3).collect()}
