import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import languages as lg
from marginalia.llm import licences as lc
from marginalia.llm import neighbours as nb
from marginalia.llm import packing as pk
from marginalia.llm import personal as pii
from marginalia.llm import repeats as rp

SF = "/root/testdata/sf0.01"


def test_boundaries_are_the_best_of_all():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 8)
        lengths = np.array(sorted(rng.sample(range(1, 60), n)))
        counts = np.array([rng.randint(1, 9) for _ in range(n)])
        for b in (1, 2, 3, 9):
            got = pk.boundaries(lengths, counts, b)
            cost = lambda cuts: sum(c * (min(x for x in cuts if x >= v) - v) for v, c in zip(lengths, counts))
            best = min(cost((*c, lengths[-1])) for k in range(min(b, n)) for c in itertools.combinations(lengths[:-1], k))
            assert len(got) <= b and cost(got) == best


def test_batches(frame, awkward):
    docs = awkward + [(100 + i, "w " * (i % 50)) for i in range(400)]
    rows = pk.packed(frame(docs), buckets=4, budget=256).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == sorted((str(i), len((t or "").split())) for i, t in docs)
    places = [(r.bucket_length, r.batch_no, r.slot) for r in rows]
    assert len(set(places)) == len(places) and len({p[0] for p in places}) <= 4
    for length in {p[0] for p in places}:
        each, n = max(1, 256 // length), sum(p[0] == length for p in places)
        assert sorted(p[1:] for p in places if p[0] == length) == [(i // each, i % each) for i in range(n)]
    assert all(r.n_tokens <= r.bucket_length for r in rows)
    assert pk.packed(frame([])).count() == 0


def vectors_with_cases():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 16))
    x = [(i, (centres[i % 30] + 0.3 * rng.normal(size=16)).tolist()) for i in range(1500)]
    x += [(2000 + i, x[50][1]) for i in range(900)] + [(7, x[7][1])]
    return x, [(9000, None), (9050, [0.0] * 16), (9100, [1.0, None] * 8), (9150, [float("nan")] * 16), (9200, [1.0]), (None, [1.0] * 16), (9250, [float("inf")] * 16), (9300, [])]


def test_neighbours_find_nine_of_ten(spark):
    good, bad = vectors_with_cases()
    rows = spark.createDataFrame([(i, v, 0, "q") for i, v in good + bad], "vec_id long, embedding array<double>, label int, query_id string")
    got = nb.nearest_neighbours(rows, F.col("id") % 50 == 0, k=5, codes=8, least=100).collect()
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    asked = sorted({i for i in ids.tolist() if i % 50 == 0})
    found = 0
    for q in asked:
        v = x[ids.tolist().index(q)]
        score = {i: float((w * v).sum() / np.sqrt((w * w).sum()) / np.sqrt((v * v).sum())) for i, w in zip(ids.tolist(), x) if i != q}
        want = sorted(score, key=lambda i: (-round(score[i], 12), i))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and len({r.vec_id for r in mine}) == 5
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        found += len({r.vec_id for r in mine} & set(want))
    assert len(got) == 5 * len(asked) and found >= 0.9 * len(got)
    assert nb.nearest_neighbours(rows.limit(0), F.col("id") % 50 == 0).count() == 0
    few = nb.nearest_neighbours(rows.where("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]


def test_neighbours_without_a_join_of_queries_and_entries(spark, monkeypatch):
    """Packs of queries met blocks of a few entries in a join, and every pair copied its vectors: 51,282 vectors took 138 s."""
    good, bad = vectors_with_cases()
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    got = []
    for small in (False, True):
        if small:
            for name, n in (("ASKED_BYTES", 2500), ("BLOCK_BYTES", 1), ("TASK_BYTES", 1 << 15), ("PACK_ROWS", 3), ("PAIRS", 7)):
                monkeypatch.setattr(nb, name, n)
        found = nb.nearest_neighbours(rows, F.col("id") % 50 == 0, k=5, codes=8, least=100)
        assert "Join" not in found._jdf.queryExecution().toString()
        got.append(sorted(map(tuple, found.collect())))
    assert len(got[0]) > 200 and got[0] == got[1]
    assert nb.nearest_neighbours(rows, F.col("id") < 0).count() == 0


def test_the_nearest_so_far_are_those_of_all_visited(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    ids = np.concatenate((np.arange(300), np.arange(100) % 7))
    x[300:320] = x[0]
    first, second = rng.integers(0, 3, 400), rng.integers(0, 4, 400)
    asked = nb.Asked(ids[:40], x[:40], rng.random((40, 3, 4)) < 0.6)
    best = nb.Nearest(asked, 3)
    for at in range(0, 400, 90):
        best.add(*(a[at : at + 90] for a in (ids, x, first, second)))
    found = sorted(zip(best.query.tolist(), (-best.scores).tolist(), best.ids.tolist()))
    want = []
    for q in range(40):
        own = {}
        for e in range(400):
            if ids[e] != ids[q] and asked.seen[q, first[e], second[e]]:
                s = float((x[e : e + 1] * x[q : q + 1]).sum(1)[0] / (np.sqrt((x[e] * x[e]).sum()) * np.sqrt((x[q] * x[q]).sum())))
                own[int(ids[e])] = max(own.get(int(ids[e]), -2.0), s)
        want += [(q, -s, i) for s, i in sorted((-s, i) for i, s in own.items())[:3] for s in (-s,)]
    assert [(q, i) for q, _, i in found] == [(q, i) for q, _, i in want]
    assert np.allclose([s for _, s, _ in found], [s for _, s, _ in want], atol=1e-12)


def test_every_query_s_true_neighbours_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nb.nearest_neighbours(rows, F.col("id") % 50 == 0, least=0).collect()
    data = rows.toPandas()
    ids, x = data.vec_id.to_numpy(), np.array(data.embedding.tolist(), float)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    want = {int(ids[i]): {int(ids[j]) for j in np.argsort(-s[i])[:5]} for i in np.flatnonzero(ids % 50 == 0)}
    assert sum(r.vec_id in want[r.query_id] for r in got) >= 0.9 * len(got)


def test_cells_are_visited_nearest_first():
    rng = np.random.default_rng(4)
    index = nb.Index(rng.normal(size=(6, 3)), rng.normal(size=(5, 3)), 1.0, cells=rng.integers(0, 4, (6, 5)))
    v = rng.normal(size=(10, 6))
    u = nb.unit(v)
    sums = nb.distances(u[:, :3], index.first)[:, :, None] + nb.distances(u[:, 3:], index.second)[:, None, :]
    for enough in (1, 10, 1000):
        seen = index.visited(v, enough)
        for q in range(10):
            order = np.argsort(sums[q].ravel())
            held = np.cumsum(index.cells.ravel()[order])
            n = min(30, int(np.searchsorted(held, enough)) + 1)
            assert set(np.flatnonzero(seen[q].ravel())) == set(order[:n])


def test_repeated_lines(frame, awkward):
    line = "a line of at least eight words that comes again"
    docs = [*awkward, (20, f"start\n{line}\nshort\n{line.upper()}  \nend"), (19, f"{line}\nshort"), (21, line)]
    got = {(r.doc_id, r.n_lines): r for r in rp.without_repeats(frame(docs)).collect()}
    assert got[19, 2].n_removed == 0 and got[19, 2].text == f"{line}\nshort"
    r = got[20, 5]
    assert r.n_removed == 2 and r.text == "start\nshort\nend"
    assert [docs[-3][1][s.start : s.end] for s in r.removed] == [line, line.upper() + "  "]
    assert got[21, 1].text == "" and got[1, 0].text is None
    assert rp.without_repeats(frame(docs)).count() == len(docs) and rp.without_repeats(frame([])).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    good = {"email": lambda s, d: True, "ip": lambda s, d: all(int(x) <= 255 for x in s.split(".")), "card": lambda s, d: 16 <= len(d) <= 19 and luhn(d), "phone": lambda s, d: 8 <= len(d) <= 15}
    return [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if good[k](m[0], re.sub("[^0-9]", "", m[0]))]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(6)
    for letters in ("a1.@ -+%", "0123456789.. -+()", "ab@.-c9%", "4 5-+."):
        for _ in range(4000):
            t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(t) == plain_base(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "a@" * 150_000, "=" * 200_000, "f" * 300_000):
        pii.base_spans(t), pii.candidates(t)


def test_personal_data(frame, awkward):
    card = "4539 1488 0343 6467"
    texts = [f"write to ann.{i}@mail.example.com or call +49 30 1234{i:03d}" for i in range(30)] + [f"my card {card} from 10.0.0.{i}" for i in range(20)]
    texts += [f'the token = "{i:x}9e8f7a6b5c4d3e2f1a0b9c8d7e6f5a4b3c2d1e0" is mine' for i in range(15)] + ["nothing here at all"] * 20
    docs = [(100 + i, t) for i, t in enumerate(texts)] + awkward
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(frame(docs)).collect()}
    for i, t in docs[: len(texts)]:
        assert [s for s in got[i] if s[0] in pii.BASE] == plain_base(t)
    secret = next(i for i, t in docs if t and "token" in t)
    assert [s[0] for s in got[secret]] == ["secret"] and got[100 + len(texts) - 1] == []
    masked = pii.redacted(frame(docs))
    assert masked.columns == frame([]).columns
    out = {r.doc_id: r for r in masked.collect()}
    assert out[100].text == "write to <EMAIL> or call <PHONE>" and out[100].n_chars == len(out[100].text)
    assert out[1].text is None and out[secret].text == 'the token = "<SECRET>" is mine'
    assert pii.personal_data(frame([])).count() == 0 and pii.redacted(frame([])).count() == 0


def test_em_finds_the_labeler_that_guesses():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    vote = lambda right: np.where(rng.random(4000) < right, truth, ~truth) * 2 - 1
    rows = np.stack([np.zeros(4000, int), vote(0.95), vote(0.9), vote(0.85), vote(0.5), np.zeros(4000, int), np.zeros(4000, int)], axis=1)
    distinct, counts = np.unique(rows, axis=0, return_counts=True)
    table, p = pii.reliabilities(distinct, counts.astype(float))
    right = [(table[j, 1, 1] + table[j, 0, 0]) / 2 for j in range(4)]
    assert right[0] > right[2] > 0.75 and abs(right[3] - 0.5) < 0.05


def plain_canonical(text):
    t = "\n".join(x for x in text.lower().split("\n") if not any(m in x for m in lc.OWNER_MARKS))
    t = " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", t) + " "
    for a, b in lc.SPELLINGS:
        t = t.replace(a, b)
    return t.strip()


def test_licences(spark, frame, awkward):
    known = {r.licence: r.text for r in lc.known_texts(spark).collect()}
    isc = "Copyright (c) 2020 Ann\n\n" + known["ISC"].replace("license", "licence").upper().replace(".", " ;")
    docs = [*awkward, (20, isc), (21, isc + " and more"), (22, "intro\n  Licensed under CC BY-NC 4.0!\nend"), (23, "(c) Ann")]
    got = {r.doc_id: r for r in lc.licences(frame(docs)).collect()}
    assert got[20].licence == "ISC" and got[21].licence is None and got[22].notices == ["CC-BY-NC-4.0"] and got[22].licence is None
    assert got[23].digest is None and got[1].digest is None and got[3].digest is None
    rows = frame(docs).select("text", lc.canonical(F.col("text")).alias("form")).where("text is not null and length(text) < 10000").collect()
    assert all(r.form == plain_canonical(r.text) for r in rows)
    assert lc.licences(frame(docs)).count() == len(docs) and lc.licences(frame([])).count() == 0


def plain_viterbi(scores):
    n = scores.shape[1]
    best = max(itertools.product(range(n), repeat=len(scores)), key=lambda p: sum(scores[i, l] for i, l in enumerate(p)) - lg.PENALTY * sum(a != b for a, b in zip(p, p[1:])))
    return sum(scores[i, l] for i, l in enumerate(best)) - lg.PENALTY * sum(a != b for a, b in zip(best, best[1:]))


def test_viterbi_finds_a_best_path():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 2, 6, 4])
    scores = (-20 * rng.random((sizes.sum(), 3))).astype(np.float32)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    for f, n, path in zip(first, sizes, lg.viterbi(scores, first, sizes)):
        s = scores[f : f + n]
        value = sum(s[i, l] for i, l in enumerate(path)) - lg.PENALTY * int((np.diff(path) != 0).sum())
        assert value == pytest.approx(plain_viterbi(s), abs=1e-3)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, lg.train(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def test_languages_of_held_out_documents(model):
    docs, m = model
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    both = lg.languages(held, m).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in both) >= 0.97 * len(both)
    assert all(0 <= r.score <= 1 for r in both)


def test_mixed_text_has_spans(spark, model, frame, awkward):
    docs, m = model
    en, de = (docs.where(f"lang = '{x}' and n_chars between 1500 and 3000").orderBy("doc_id").first().text for x in ("en", "de"))
    row = lg.languages(frame([(1, en + " " + de)]), m).first()
    assert [s.lang for s in row.spans] == ["en", "de"] and abs(row.spans[0].end - len(en.split())) < 12 and row.score < 1
    got = {(r.doc_id, r.lang_pred) for r in lg.languages(frame(awkward), m).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und")} <= got and (4, "und") not in got
    empty = lg.train(frame([]), F.lit(True))
    assert {r.lang_pred for r in lg.languages(frame(awkward), empty).collect()} == {"und"}
    kept = lg.recognised(frame(awkward), m)
    assert kept.columns == frame([]).columns and {r.doc_id for r in kept.collect()} == {None, 4, 5, 6, 7, 8, 9}
