"""Substrings of all words of a batch at once, and the idf of terms without a table of all for each batch."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from marginalia import plugins
from marginalia.operators import topk
from marginalia.operators.grams import Grams


def said(rng, letters, n=40):
    return [[f" {''.join(rng.choices(letters, k=rng.randint(1, 7)))} " for _ in range(rng.randint(0, 9))] for _ in range(n)]


@pytest.mark.parametrize("letters", ["abc", "aé\U0001f600ßz"])
def test_substrings_are_those_of_words_cut_one_by_one(letters):
    lists = pa.array(said(random.Random(1), letters), pa.list_(pa.string()))
    terms = topk.Terms((3, 5))
    doc, ids, tf = terms.counts(lists)
    names = terms.names()
    cut = Grams((3, 5))
    d, i, t, codes = cut.counts(lists)
    own = cut.names(codes).to_pylist()
    assert sorted(zip(d.tolist(), (own[x] for x in i), t.tolist())) == sorted(zip(doc.tolist(), (names[x] for x in ids), tf.tolist()))
    assert cut.codes(pa.array(own)).tolist() == codes.tolist()


def test_with_a_given_alphabet_what_has_other_characters_is_left_out():
    cut = Grams((3, 5), pa.array(["ab", " "]))
    _, i, _, codes = cut.counts(pa.array([[" abxab "], [" aba "]]))
    assert sorted(cut.names(codes).to_pylist()) == sorted([" ab", "ab ", "aba", "ba ", " aba", "aba ", " aba "])


def test_more_characters_than_there_are_numbers_for(spark):
    rows = [(i, [f" {chr(0x4E00 + 500 * i + j)}{chr(0x4E00 + 500 * i + j + 1)} " for j in range(400)] + [" ab ", " a\0b "]) for i in range(20)]
    counted = spark.createDataFrame(rows, "doc long, words array<string>").coalesce(1)
    found = {r.term: (r.df, r.cf) for r in topk.vocabulary(counted, 20, grams=(3, 5)).collect()}
    terms = topk.Terms((3, 5))
    doc, ids, tf = terms.counts(pa.array([w for _, w in rows], pa.list_(pa.string())))
    names = terms.names()
    assert found == {names[n]: (int((ids == n).sum()), int(tf[ids == n].sum())) for n in range(len(names))}


def test_places_do_not_make_a_table_of_all_terms(monkeypatch):
    """index_in made one of half a million terms for every batch of documents."""
    names = [f"t{i}" for i in range(1000)]
    sent = topk.Sent(pa.array(names), np.arange(1000.0))
    monkeypatch.setattr(pc, "index_in", None)
    assert sent.of(pa.array(["t7", "other", "t999", ""])).tolist() == [7.0, 0.0, 999.0, 0.0]


def test_letters_are_counted_once_for_a_text(spark):
    texts = ["", None, "Zebra zoo", "ÀÉ straße K", "q" * 5000, *(f"word {i}" for i in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    got = {r.n: r.vector for r in plugins.letter_encoder()(rows.where("n <> 2999")).select("n", "vector").collect()}
    for n, text in enumerate(texts):
        if n != 2999:
            low = rows.sparkSession.range(1).select(F.lower(F.lit(text or ""))).first()[0] if n < 5 else text
            v = np.array([low.count(chr(97 + i)) for i in range(26)], float)
            assert got[n] == (v / (np.sqrt((v * v).sum()) or 1.0)).tolist()
