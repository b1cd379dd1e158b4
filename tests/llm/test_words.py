import random
import re

import numpy as np
import pyarrow as pa

from marginalia.llm import textwords as tw


def test_words_are_those_of_the_patterns(monkeypatch):
    monkeypatch.setattr(tw, "PIECE_BYTES", 16)
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \n\t-é日_9\x0b") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", None, "x" * 500]
    for table, pattern in ((tw.whitespace_words(), r"[^\x20\x09-\x0D]+"), (tw.alphanumeric_words(), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        offsets, data = tw.as_bytes(pa.array(texts))
        w = tw.words_of(offsets, data, table)
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        want = [re.findall(pattern, t) for t in low]
        assert np.diff(w.first).tolist() == [len(x) for x in want]
        flat = [x for ws in want for x in ws]
        same = {}
        for word, h in zip(flat, w.hash.tolist()):
            assert same.setdefault(word, h) == h
        assert len(set(same.values())) == len(same)


def test_a_slice_of_an_array_and_a_long_text_are_whole():
    array = pa.array(["skip", "a b", "c" * 100, "d"])[1:]
    offsets, data = tw.as_bytes(array)
    assert bytes(data) == b"a b" + b"c" * 100 + b"d"
    assert list(tw.slices(offsets, 10)) == [(0, 1), (1, 2), (2, 3)]
