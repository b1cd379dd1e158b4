import random
import string
import time

import pytest

from marginalia.llm import personal as pii

RNG = random.Random(8)
LONG = "".join(RNG.choice(string.ascii_letters + "-_.") for _ in range(1000))


@pytest.mark.parametrize("name", ["token=", "DB_PASSWORD=", "API_TOKEN: ", "aws_secret_access_key = ", "apiToken: '", "x-api-key: "])
def test_long_values_and_longer_names_are_whole_candidates(name):
    text = f"set {name}{LONG} now"
    assert text.index(LONG) in {a for a, _ in pii.secrets(text)}
    assert [text[a:b] for k, a, b, _ in pii.candidates(text) if k == "secret"] == [LONG]


def test_known_beginnings_are_whole():
    key = "ghp_" + "aB3" * 300
    assert [(a, b) for k, a, b, _ in pii.candidates(f"see {key} here") if k == "secret"] == [(4, 4 + len(key))]


def test_names_that_only_end_alike_are_none():
    for text in ("mytoken=abcdef1234", "a" * 40 + "token=abcdef1234", "tokens=abcdef1234", "tokenized: abcdef1234"):
        assert not list(pii.secrets(text)), text


def test_values_in_values_take_linear_time():
    began = time.time()
    for text in ("token=" * 200_000, "token:" * 200_000, "a_token=" + "x" * 1_000_000):
        assert next(iter(pii.secrets(text)))[1] == len(text)
        list(pii.secrets(text))
    assert time.time() - began < 20


def test_nothing_of_a_long_secret_remains(frame):
    docs = [(i, f"the token = {i:x}9e8f7a6b5c4d3e2f{LONG[i:]}{LONG[:i]} is mine") for i in range(30)] + [(100 + i, f"DB_PASSWORD={LONG[i:]}{i}x7") for i in range(30)]
    out = {r.doc_id: r.text for r in pii.redacted(frame(docs)).collect()}
    assert {out[i] for i in range(30)} == {"the token = <SECRET> is mine"} and {out[100 + i] for i in range(30)} == {"DB_PASSWORD=<SECRET>"}
