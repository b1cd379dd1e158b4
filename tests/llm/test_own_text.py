"""Rows that share an id, or have none, are judged by their own text."""

import random

from marginalia.llm import contamination as ct
from marginalia.llm import jaccard


def test_contaminated_rows_go_whatever_the_size_of_the_benchmark(spark, frame):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["the", "of", "été", "x1", "zeta", "nu", "mu"]) for _ in range(30))
    items = [(i, text()) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = "nothing of the sort is in here at all"
    docs = [(None, items[0][1]), (None, clean), (1, items[1][1]), (1, clean), (1, None), (2, clean), (3, items[5][1])]
    for block in (2_000_000, 40):
        kept = ct.decontaminated(frame(docs), bench, block_words=block).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted([("None", clean), ("1", clean), ("1", "None"), ("2", clean)]), block


def test_groups_take_only_their_own_rows(frame):
    a, b, c = ("one two three four five six seven", "other words that stand in no relation", "third text with quite other content again")
    docs = [(1, a), (5, a), (5, b), (7, b + " at"), (7, c), (8, None), (8, ""), (8, ""), (None, a), (9, c), (9, c), (1, a), (1, c)]
    kept = jaccard.one_of_each_group(frame(docs), k=5, threshold=(4, 5)).collect()
    got = sorted((str(r.doc_id), str(r.text)) for r in kept)
    assert got == sorted([("1", a), ("5", b), ("7", b + " at"), ("8", "None"), ("8", ""), ("None", a), ("1", c)])


def test_of_near_copies_under_one_id_one_stays(frame):
    words = [f"w{i}" for i in range(60)]
    docs = [(3, " ".join(words)), (3, " ".join(words) + " more"), (4, " ".join(words)), (3, "quite another text than those above")]
    kept = sorted(r.text for r in jaccard.one_of_each_group(frame(docs)).collect())
    assert kept == sorted(["quite another text than those above", " ".join(words)])
