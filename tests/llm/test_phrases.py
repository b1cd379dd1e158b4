import random
import re
from collections import Counter

import pytest

from marginalia.llm import common, phrases
from marginalia.llm.phrases import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, n long, score long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, length=4, least=30, inside=80, best=2000):
    counts, sizes = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und" if lang != "" else ""
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in range(1, length + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    known = {p: f for p, f in counts.items() if f >= least}
    out = []
    for lang in sizes:
        scored = []
        own = {w: f for (x, w), f in known.items() if x == lang}
        longest = Counter()
        for w, f in own.items():
            for k in range(2, len(w)):
                for i in range(len(w) - k + 1):
                    longest[w[i : i + k]] = max(longest[w[i : i + k]], f)
        for w, a in own.items():
            if len(w) > 1 and not (longest[w] and 100 * longest[w] >= inside * a):
                score, _, l, r = min((2_000_000 * a // (own[w[:k]] + own[w[k:]]), k, own[w[:k]], own[w[k:]]) for k in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def invented(seed, n, vocabulary):
    random.seed(seed)
    words = [random.choice(["the", "of", "été", "日本", "x y", "a\u0000b", "Big"]) if i < 3 else f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(random.randint(0, 60)):
            text += random.choices(words, [3 if i < 4 else 1 for i in range(vocabulary)])[0] + random.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "   "])
        out.append((text, random.choice(["en", "fr", None, ""])))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, lang, "p", 1, 2, 3) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(x) for x in collocations(df, **options).collect())


@pytest.mark.parametrize(("parts", "stretch", "best"), [(2, 1 << 22, 2000), (40, 1 << 22, 7), (200, 150, 30), (200, 150, None)])
def test_equal_to_counting_everything(spark, parts, stretch, best):
    """With few parts no prefix is heavy; with many, prefixes of one to three words are, and texts are cut in short stretches."""
    rows = invented(1, 150, 9) + [("the of été. " * 200 + "of the " * 300, "en"), ("x" * 100_000 + " the of" * 20, "fr"), (None, "en"), ("", None), (" . , ", "de")]
    want = plain(rows, least=12, best=best)
    assert len(want) > 20
    assert found(spark, rows, least=12, parts=parts, stretch=stretch, best=best, block=2) == want


def test_heavy_prefixes_are_told(spark):
    rows = [("one two three four. " * 400, "en"), ("five six " * 50, "en")]
    df = phrases._texts(spark.createDataFrame([(0, t, lang, "p", 1, 2, 3) for t, lang in rows], SCHEMA))
    _, heavy = phrases.heavy_prefixes(df, 4, 3)
    assert {p for _, p in heavy} >= {"one", "one two", "one two three"} and "five" not in {p for _, p in heavy}


def test_best_of_each_language_ties_and_repeated_rows(spark):
    rows = [("a b. c d. e f", "en")] * 5 + [("a b. c d", "fr")] * 5
    want = plain(rows, least=5, best=2)
    assert [w[:3] for w in want] == [("en", 1, "a b"), ("en", 2, "c d"), ("fr", 1, "a b"), ("fr", 2, "c d")]
    assert found(spark, rows, least=5, best=2) == want


def test_phrases_inside_longer_ones_go_even_if_these_go_too(spark):
    rows = [("p q r s", "en")] * 40 + [("p q r", "en")] * 5 + [("p q", "en")] * 20 + [("z p", "en")] * 31
    assert found(spark, rows) == plain(rows)
    assert {x[2] for x in plain(rows)} == {"p q r s", "p q", "z p"}


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [("", "en")]) == []


def test_large_counts_are_exact(spark):
    """Scores of counts whose products pass 64 bits."""
    a, l, r = 9 * 10**17, 9 * 10**17 + 7, 9 * 10**17 + 11
    row = spark.sql(f"select (cast(2000000 as decimal(10, 0)) * cast({a} as decimal(20, 0))) div (cast({l} as decimal(20, 0)) + cast({r} as decimal(20, 0))) as s").first()
    assert row.s == 2_000_000 * a // (l + r)


def test_looked_up_with_hot_keys(spark):
    rows = spark.createDataFrame([("h" if i % 3 else f"k{i}", i) for i in range(600)] + [(None, 1)], "k string, i long")
    known = spark.createDataFrame([("h", 5)] + [(f"k{i}", i) for i in range(0, 600, 6)], "k string, v long")
    want = sorted(map(str, rows.join(known, "k").collect()))
    assert sorted(map(str, common.looked_up(rows, known, ["k"]).collect())) == want
    assert sorted(map(str, common.looked_up(rows, known, ["k"], most=10, least_hot=50).collect())) == want
    left = sorted(map(str, rows.join(known, "k", "left").collect()))
    assert sorted(map(str, common.looked_up(rows, known, ["k"], "left", most=10, least_hot=50).collect())) == left
