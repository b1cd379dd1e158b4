import random
import time

from pyspark.sql import functions as F

from marginalia.llm import personal
from marginalia.llm.queries import held_out


def plain(text):
    """candidates() with every span compared with all that are kept."""
    found = [("email", a, b, True) for a, b in personal.emails(text)]
    digits = list(personal.numbers(text))
    found += [x for x in digits if x[3]]
    kept = [(a, b) for _, a, b, _ in found]
    free = lambda a, b: all(b <= x or y <= a for x, y in kept)
    for a, b in sorted(set(personal.secrets(text)), key=lambda x: (x[0], -x[1])):
        if free(a, b):
            found.append(("secret", a, b, True))
            kept.append((a, b))
    for kind, a, b, good in digits:
        if kind == "card" and not good and 12 <= sum(c.isdigit() for c in text[a : min(b, a + 64)]) <= 19 and free(a, b):
            found.append(("account", a, b, False))
            kept.append((a, b))
    return found


def test_equal_to_comparing_with_all_spans():
    random.seed(2)
    pieces = ["ann@example.org", "api_key=abcDEF123456ghiJKL", "password: hunter2secret9", "4111 1111 1111 1111", "1234567890123", "+44 20 7946 0958", "10.0.0.1", "token = 0123456789abcdef0123456789abcdef", "text", "a=b", "sk-abcdefghijklmnop1234"]
    for _ in range(300):
        text = "".join(random.choice(pieces) + random.choice([" ", "", ", ", "\n"]) for _ in range(random.randint(0, 12)))
        assert personal.candidates(text) == plain(text)


def test_very_many_spans_in_one_text():
    text = "write to ann@example.org or api_key=abcDEF123456ghiJKL or 1234567890123, " * 30_000
    began = time.time()
    found = personal.candidates(text)
    assert len(found) > 60_000 and time.time() - began < 20


def test_a_document_without_an_id_is_learned_from(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,), (5,)], "doc_id long").select("doc_id", held_out().alias("h"))
    assert rows.where("h is null").count() == 0 and not rows.where("doc_id is null").first().h
