import random
import re

from marginalia.llm import contamination as ct

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        if i is not None and n:
            windows += [(i, w[j : j + n]) for j in range(len(w) - n + 1)]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for j in range(len(w) - len(x) + 1):
                if w[j : j + len(x)] == x:
                    hit |= set(range(j, j + len(x)))
                    found.add(i)
        out.append((str(d), len(w), len(hit), sorted(found, key=str)))
    return sorted(out)


def cases(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "Of", "été", "x1", "zeta", "nu", "mu"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 12, 13, 14, 30]))) for i in range(12)] + [(3, "repeated id of an item"), (None, "no id"), (20, None), (21, " - "), (100, items_text := text(20))]
    docs = [(i, text(rng.choice([0, 5, 40, 200]))) for i in range(40)] + [(50, f"{text(9)} {t.upper()}, {text(9)}") if t else (51, None) for _, t in items] + [(60, items_text), (60, items_text)]
    return docs, items


def test_equals_a_plain_search(spark, frame):
    for seed in (1, 2):
        docs, items = cases(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        for block in (2_000_000, 40):
            found = ct.contamination(frame(docs), bench, block_words=block).collect()
            assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found) == plain(docs, items), block


def test_decontaminated_takes_out_those_and_no_others(spark, frame, awkward):
    docs, items = cases(3)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    items = [x for x in items if len(words(x[1])) > 10]
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {d for d, n, hit, _ in plain(docs, items) if hit and 20 * hit >= n}
    for block in (2_000_000, 40):
        kept = ct.decontaminated(frame(docs), bench, block_words=block)
        assert kept.columns == frame([]).columns
        assert {str(r.doc_id) for r in kept.collect()} == {str(d) for d, _ in docs} - bad
    assert ct.decontaminated(frame(awkward), bench).count() == len(awkward)
    assert ct.decontaminated(frame(awkward), bench.limit(0)).count() == len(awkward)
    assert ct.contamination(frame([]), bench).count() == 0
