"""op6 and op10 as they are registered, against versions in plain Python."""

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import common, languages, queries
from marginalia.llm import passages as ps
from tests.llm.test_operators import plain_base

SF = "/root/testdata/sf0.001"
BASE = ("email", "ip", "card", "phone")


def test_op6_counts_digest_and_spelling(spark):
    texts = {r.doc_id: r.text or "" for r in common.read(spark, SF, "documents").collect()}
    rows = queries.op6_personal_data(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = sorted(plain_base(texts[r.doc_id]), key=lambda s: (BASE.index(s[0]), s[1]))
        spelled = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in base) for k in BASE]
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if s.split(":")[0] in BASE] == spelled
        for s in every:
            kind, a, b = s.split(":")
            assert kind in (*BASE, "account", "secret") and 0 <= int(a) < int(b) <= len(texts[r.doc_id])


def plain_scores(word, model):
    """(scores by language, letters) of a word, gram by gram."""
    codes = [ord(c) + 1 if c.isalpha() and ord(c) < 0x323B0 else 1 for c in word]
    letters = [c for c in word if c.isalpha()]
    if not letters:
        return [0.0] * len(model.names), 0
    padded, mask = [1, *codes, 1], (1 << 64) - 1
    script = int(languages.scripts_of(np.array([ord(letters[0])]))[0])
    able = [bool(w) for w in model.written[:, script]]
    total = [0.0] * len(model.names)
    for n in range(1, languages.LONGEST_GRAM + 1):
        for i in range(len(padded) - n + 1):
            seg = padded[i : i + n]
            if any(c == 1 for c in seg[1:-1]) or (seg[0] == 1 and seg[-1] == 1):
                continue
            value = 0
            for c in seg:
                value = (value * 0x9E3779B97F4A7C15 + c) & mask
            bucket = (((value + n) * 0xD6E8FEB86659FD93) & mask) >> 48
            for k in range(len(total)):
                total[k] += float(model.weights[k][bucket])
    if not any(able):
        return [0.0] * len(total), len(letters)
    total = [0.5 * t if a else -math.inf for t, a in zip(total, able)]
    return [t - max(total) for t in total], len(letters)


def plain_language(text, model):
    words = (text or "").lower().split()
    seen = {w: plain_scores(w, model) for w in set(words)}
    langs = range(len(model.names))
    value, back = None, []
    for w in words:
        s = seen[w][0]
        if value is None:
            value = list(s)
            continue
        came = [max(langs, key=lambda j: value[j] - (languages.PENALTY if j != k else 0)) for k in langs]
        value = [value[came[k]] - (languages.PENALTY if came[k] != k else 0) + s[k] for k in langs]
        back.append(came)
    letters = [0] * len(model.names)
    if value:
        at = max(langs, key=lambda k: value[k])
        path = [at]
        for came in reversed(back):
            at = came[at]
            path.append(at)
        for w, k in zip(reversed(words), path):
            letters[k] += seen[w][1]
    if not sum(letters):
        return "und", 0.0
    best = max(langs, key=lambda k: letters[k])
    return model.names[best], letters[best] / sum(letters)


def test_op10_labels_and_scores(spark):
    docs = common.read(spark, SF, "documents")
    model = languages.train(docs, ~queries.held_out())
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op10_languages(spark, SF).collect()
    assert len(rows) == len(texts)
    near = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        lang, score = plain_language(texts[r.doc_id], model)
        assert lang == r.lang_pred
        # of equally good paths either may be taken, and sums of floats differ in their last digits
        near += abs(score - r.score) < 1e-9
        assert abs(score - r.score) < 0.05
    assert near >= 0.98 * len(rows)


def test_words_are_scored_in_languages_of_their_script_alone(spark):
    rows = [(i, "пример русского текста и еще слова " * 3, "ru") for i in range(20)] + [(100 + i, "an example of an english text " * 3, "en") for i in range(20)] + [(200 + i, "ein beispiel eines deutschen textes " * 3, "de") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.train(docs, F.lit(True))
    scores, letters = model.score(["пример", "example", "12", "日本"], languages.letter_table())
    ru = model.names.index("ru")
    assert scores[0, ru] == 0 and all(scores[0, k] == languages.EXCLUDED for k in range(3) if k != ru)
    assert scores[1, ru] < languages.EXCLUDED / 2 and (scores[2:] == 0).all() and letters.tolist() == [6, 7, 0, 2]


def test_a_long_text_in_pieces_has_the_path_of_the_whole(spark):
    docs = common.read(spark, SF, "documents")
    labeler = languages.Labeler(languages.train(docs, ~queries.held_out()))
    texts = [r.text for r in docs.orderBy("doc_id").limit(40).collect()]
    whole = " ".join(texts)
    (want,), _ = labeler.label([whole])
    labeler.piece = 1024
    (got,), (letters,) = labeler.label([whole])
    assert len(got) == len(whole.split()) and letters.sum() > 0 and (got == want).mean() > 0.999


def test_hot_forms_meet_under_several_keys(frame, monkeypatch):
    common_part = " ".join(f"w{i}" for i in range(40)) + "."
    docs = [(i, f"Text number {i} begins with words of its own x{i}. {common_part}") for i in range(60)]
    want = sorted((r.doc_id, r.n_removed, r.text) for r in ps.without_passages(frame(docs)).collect())
    monkeypatch.setattr(ps, "LEAST_HOT", 10)
    got = sorted((r.doc_id, r.n_removed, r.text) for r in ps.without_passages(frame(docs)).collect())
    assert got == want and sum(n for _, n, _ in got) == 59
