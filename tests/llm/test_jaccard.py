import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.llm import jaccard
from marginalia.llm.graph import components


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def plain(docs, k, a, b):
    s = [sets(t, k) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if s[i] and s[j] and b * len(s[i] & s[j]) >= a * len(s[i] | s[j]):
                group[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(docs):
        same = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        out.append((str(d), len(s[i]), str(min(same, default=None) if s[i] else d)))
    return sorted(out)


def near_copies(seed, n_base, copies, sizes):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(12)]
    docs = []
    for _ in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        for _ in range(rng.randint(1, copies)):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(t + (shared if rng.random() < 0.3 else []))))
    return docs


@pytest.mark.parametrize("k,threshold", [(3, (9, 10)), (5, (4, 5))])
def test_groups_equal_a_plain_join(frame, awkward, k, threshold, monkeypatch):
    monkeypatch.setattr(jaccard, "TABLE_BITS", 10)
    docs = near_copies(k, 14, 9, [3, 20, 60, 150, 900]) + [(None if i is None else i + 10_000, t) for i, t in awkward]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_groups(frame(docs), k, threshold).collect())
    assert got == plain(docs, k, *threshold)


def test_a_block_larger_than_is_tested_goes_on_whole(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL_BLOCK", 3)
    docs = near_copies(9, 2, 40, [40]) + near_copies(8, 1, 40, [41])
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_groups(frame(docs), 3, (9, 10)).collect())
    assert got == plain(docs, 3, 9, 10)


def test_one_of_each_group(frame, awkward):
    kept = jaccard.one_of_each_group(frame([*awkward, (20, "one two three four five six"), (19, "one two three four five six")]))
    assert kept.columns == frame([]).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 19 in ids and 20 not in ids and ids.count(4) == 1 and 5 not in ids and ids.count(None) == 2 and {1, 2, 3, 7, 8, 9} <= set(ids)
    assert jaccard.one_of_each_group(frame([])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)] + [(200, i) for i in range(201, 230)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 102)} == {100} and {got[i] for i in range(200, 230)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sets_that_share_a_key_are_told_apart(frame, monkeypatch):
    monkeypatch.setattr(jaccard, "KEY_BITS", 4)
    docs = near_copies(5, 12, 5, [3, 20, 60])
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.similar_groups(frame(docs), 3, (9, 10)).collect())
    assert got == plain(docs, 3, 9, 10)


def test_columns_of_any_name_and_type(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, {"a": 1}, 0.5, 1), (1, text, {"a": 1}, 0.5, 1), (1, text, {"b": 2}, None, 0), (2, text + " more", {}, 1.0, 0), (3, "quite another text", None, 2.0, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` map<string,int>, _gone double, `id` int").withColumns({"sha": F.lit("x"), "may": F.lit(1), "group": F.lit(2)})
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, text), (3, "quite another text")]
