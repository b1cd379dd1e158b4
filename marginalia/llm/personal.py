"""Personal data by weak supervision.

Candidates are found by patterns.  Four labelers vote on each (for, against, or no vote): the check
that belongs to the pattern, a gazetteer, the words in front of it, and its shape.  Votes are counted
over the whole corpus; there are only a few hundred kinds of vote, so expectation-maximisation over
those counts estimates how far each labeler can be trusted, without labels.  Its posteriors then train
a logistic classifier of spans, again over counts of all candidates.  A second pass applies it.

Four base kinds (email, ip, card, phone) are defined by a pattern and a check alone: such spans are
always kept.  The classifier decides on the added kinds: account (long digit groups that fail the
base checks) and secret (keys, tokens and passwords).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textwords import slices

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "secret")
KINDS = (*BASE, *ADDED)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Every ip, card and phone lies in one run of these characters.
_NUMERIC = re.compile(r"[+0-9][\x20().0-9+-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])")
_VALUE = re.compile(r"\s{0,3}[\"']?([^\s\"'<>,;]{6,}+)")
_NAME = re.compile(r"([A-Za-z_-]{2,})\s{0,2}[\"']?$")

# Names in front of "=" or ":" that hold a secret, and how public services begin theirs.
SECRET_NAMES = frozenset("password passwd pwd passphrase secret token apikey api_key api-key access_key access-key auth_token client_secret private_key".split())
SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk-", "AIza")
# Words that speak for a kind when they stand close before it, and words against all.
CUES = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "debit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "account": ("account", "card", "iban", "credit", "payment"),
    "secret": ("password", "token", "secret", "key", "login"),
}
AGAINST = ("version", "isbn", "order", "commit", "checksum", "sha1", "sha256", "md5", "invoice", "section", "chapter")
# Common top-level domains; one- and two-digit calling codes; first digits of cards.
DOMAINS = frozenset("com org net edu gov io info biz co uk de fr es it nl eu us ca au jp in br ru ch se no pl at be".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98")
CARD_STARTS = "3456"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = ord(d) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: every match has one "@", its local part is the run of local characters
    before that, back to the match before."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def small_parts(ip: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and (not p or int(p) <= 255) for part in ip.split("."))


def numbers(text: str):
    """(kind, start, end, whether it passes its check) of all ip, card and phone matches."""
    for region in _NUMERIC.finditer(text):
        a, b = region.span()
        if b - a < 7:
            continue
        for m in _IP.finditer(text, a, b):
            yield "ip", m.start(), m.end(), small_parts(m[0])
        for m in _CARD.finditer(text, a, b):
            digits = _NOT_DIGIT.sub("", m[0])
            yield "card", m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)
        for m in _PHONE.finditer(text, a, b):
            yield "phone", m.start(), m.end(), 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    found = [("email", a, b) for a, b in emails(text)]
    found += [(k, a, b) for k, a, b, good in numbers(text) if good]
    return sorted(found, key=lambda x: (BASE.index(x[0]), x[1]))


_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


def secret_name(name: str) -> bool:
    """Whether a listed name is all of an identifier or the last part of it, after "_" or "-" or where
    capitals begin: DB_PASSWORD, aws_secret_access_key, apiToken."""
    if name.lower() in SECRET_NAMES:
        return True
    parts = re.split("[_-]", _HUMP.sub("_", name).lower())
    return any("_".join(parts[-n:]) in SECRET_NAMES for n in (1, 2))


def secrets(text: str):
    """(start, end) of what may be secrets: values after a name, known beginnings, long hex digits.
    All are taken whole, however long they are."""
    for mark in "=:":
        at, run = text.find(mark), 0  # run: the end of the last value; one that begins inside of it ends there too
        while at >= 0:
            from_ = max(0, at - 32)
            name = _NAME.search(text, from_, at)
            if name:
                cut = name.start() == from_ and from_ and text[from_ - 1].isalpha()
                if secret_name("x" * bool(cut) + name[1]):
                    if at + 1 < run:
                        if run - at > 6:
                            yield at + 1, run
                    elif m := _VALUE.match(text, at + 1):
                        run = m.end(1)
                        yield m.span(1)
            at = text.find(mark, at + 1)
    for begins in SECRET_STARTS:
        at = text.find(begins)
        while at >= 0:
            end = at + len(begins)
            while end < len(text) and (text[end].isalnum() and text[end].isascii() or text[end] in "_-"):
                end += 1
            if end - at >= len(begins) + 12 and not (at and text[at - 1].isalnum()):
                yield at, end
            at = text.find(begins, end)
    for m in _HEX.finditer(text):
        yield m.span()


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """All candidates, (kind, start, end, check), base matches first."""
    found = [("email", a, b, True) for a, b in emails(text)]
    digits = list(numbers(text))
    found += [x for x in digits if x[3]]
    # base spans may overlap: of those that begin before a place only the greatest end matters
    kept = sorted((a, b) for _, a, b, _ in found)
    starts, ends = [a for a, _ in kept], list(accumulate((b for _, b in kept), max))
    taken: list[tuple[int, int]] = []  # in order, none overlaps another

    def free(a, b):
        i, j = bisect_left(starts, b), bisect_left(taken, (b,))
        return not (i and ends[i - 1] > a) and not (j and taken[j - 1][1] > a)

    if digits or "=" in text or ":" in text or any(s in text for s in SECRET_STARTS):
        for a, b in sorted(set(secrets(text)), key=lambda x: (x[0], -x[1])):
            if free(a, b):
                found.append(("secret", a, b, True))
                insort(taken, (a, b))
        for kind, a, b, good in digits:
            if kind == "card" and not good and 12 <= sum(c.isdigit() for c in text[a : min(b, a + 64)]) <= 19 and free(a, b):
                found.append(("account", a, b, False))
                insort(taken, (a, b))
    return found


def votes(text: str, kind: str, start: int, end: int, good: bool) -> tuple[int, int, int, int]:
    """The labelers' votes: check, gazetteer, context, shape."""
    span = text[start:end]
    before = text[max(0, start - 40) : start].lower()
    digits = [c for c in span if c.isdigit()]
    if kind == "email":
        gazetteer = 1 if span.rpartition(".")[2].lower() in DOMAINS else -1
        shape = 1 if any(c.isalpha() for c in span.partition("@")[0]) else 0
    elif kind == "ip":
        head = span.split(".")
        gazetteer = -1 if head[0] in ("0", "127", "10", "255") or head[:2] == ["192", "168"] else 1
        shape = 1 if len(set(head)) > 2 else -1
    elif kind == "phone":
        number = "".join(digits)
        gazetteer = 1 if number.startswith(CALLING) else -1
        shape = 1 if len(set(digits)) > 3 else -1
    elif kind in ("card", "account"):
        gazetteer = (1 if digits[0] in CARD_STARTS else -1) if kind == "card" else 0
        shape = 1 if len(set(digits)) > 4 else -1
    else:
        gazetteer = 1 if span.startswith(SECRET_STARTS) or any(n in before for n in SECRET_NAMES) else 0
        shape = 1 if digits and len(set(span)) >= 8 and any(c.isalpha() for c in span) else -1
    context = 1 if any(c in before for c in CUES[kind]) else -1 if any(c in before for c in AGAINST) else 0
    return (1 if good and kind != "secret" else 0 if kind == "secret" else -1), gazetteer, context, shape


def features(text: str, c: tuple[str, int, int, bool]) -> tuple:
    """Kind, votes, and length and share of digits in steps."""
    kind, start, end, good = c
    size = end - start
    share = sum(x.isdigit() for x in text[start : min(end, start + 64)]) / min(size, 64)
    return (KINDS.index(kind), *votes(text, kind, start, end, good), int(np.searchsorted((8, 16, 32), size)), int(share * 2.999))


def reliabilities(rows: np.ndarray, counts: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """EM over counted votes: how probable a vote against and a vote for is with each labeler and class
    (labeler, class, vote), and the probability that each row is personal data.  It starts from the
    majority; a labeler that gives no vote says nothing."""
    cast = rows[:, 1:5] != 0
    v = (rows[:, 1:5] > 0).astype(int)
    kind = rows[:, 0]
    p = 1 / (1 + np.exp(-1.5 * (rows[:, 1:5].sum(1))))
    table = np.full((4, 2, 2), 1 / 2)
    for _ in range(rounds):
        for j in range(4):
            for z, weight in ((0, 1 - p), (1, p)):
                t = np.bincount(v[:, j], weights=weight * counts * cast[:, j], minlength=2) + (3.0, 1.0)[:: 1 - 2 * z]
                table[j, z] = t / t.sum()
        prior = (np.bincount(kind, weights=p * counts, minlength=len(KINDS)) + 1) / (np.bincount(kind, weights=counts, minlength=len(KINDS)) + 2)
        prior = np.clip(prior, 0.02, 0.98)
        odds = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(4):
            odds = odds + cast[:, j] * np.log(table[j, 1, v[:, j]] / table[j, 0, v[:, j]])
        p = 1 / (1 + np.exp(-odds))
    return table, p


def design(rows: np.ndarray) -> np.ndarray:
    """One column for each kind, vote, step of length and step of digits."""
    cols = [rows[:, 0:1] == np.arange(len(KINDS))]
    cols += [rows[:, j : j + 1] == np.array([-1, 1]) for j in range(1, 5)]
    cols += [rows[:, 5:6] == np.arange(4), rows[:, 6:7] == np.arange(3)]
    return np.hstack(cols).astype(float)


def fit(rows: np.ndarray, counts: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights of the logistic classifier, by Newton steps on the posteriors, with a small ridge."""
    x = design(rows)
    w = np.zeros(x.shape[1])
    if not len(rows):
        return w
    target = reliabilities(rows, counts)[1]
    weight = counts / counts.sum() * len(counts)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (target - p)) - 0.01 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame) -> np.ndarray:
    """The classifier of a corpus.  Every candidate of every document counts; the driver gets one row
    for each distinct combination of features, of which there are a few thousand at most."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    found.update(features(text, c) for c in candidates(text))
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], ["features", "n"])

    counted = common.documents(docs).select("text").mapInArrow(count, "features array<int>, n long")
    got = counted.groupBy("features").agg(F.sum("n").alias("n")).collect()
    got.sort(key=lambda r: r.features)
    return fit(np.array([r.features for r in got], int).reshape(-1, 7), np.array([r.n for r in got], float))


def spans_of(text: str, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Base spans, and what the classifier adds to them; by kind as listed, then start."""
    found = candidates(text)
    if not found:
        return []
    added = [c for c in found if c[0] in ADDED]
    kept = [c[:3] for c in found if c[0] in BASE]
    if added:
        good = design(np.array([features(text, c) for c in added])) @ weights > 0
        kept += [c[:3] for c, g in zip(added, good) if g]
    return sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1]))


_SPANS = "spans array<struct<kind:string,start:long,end:long>>"


def _slices(batches, column: int):
    """Batches in slices of about 1 MB of text, or of one text where that is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
        for i, j in slices(np.concatenate(([0], np.cumsum(sizes)))):
            yield batch.slice(i, j - i)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every document.

    A null text counts as empty; repeated rows and null ids give a row each; other columns are
    ignored.  An empty table gives no row.  Texts are searched whole, some 1 MB of them at a time."""
    weights = train(docs)

    def find(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in _slices(batches, 1):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t or "", weights)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return common.documents(docs).mapInArrow(find, f"doc_id long, {_SPANS}")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; of spans that overlap, the union is replaced."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text; n_chars, where there is one, is that of the new text.

    Null and empty texts stay as they are; repeated rows, and rows without an id, are masked each by its own
    text, of any length and whole.  Empty tables give no row.  No column is added, so none clashes."""
    weights = train(docs)

    place, typed = docs.columns.index("text"), docs.withColumn("text", F.col("text").cast("string"))

    def mask(batches):
        for batch in _slices(batches, place):
            columns = list(batch.columns)
            texts = columns[place].to_pylist()
            columns[place] = pa.array([None if t is None else masked(t, s) if (s := spans_of(t, weights)) else t for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = typed.mapInArrow(mask, typed.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
