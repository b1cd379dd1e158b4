"""Languages of texts, and of their parts where languages mix.

The script of a word narrows the languages that it can be in to those seen in that script; under these
alone, and only if they are several, it is scored by character n-grams.  Viterbi then labels all words of a
text at once: a change of language costs a fixed penalty, so a stray word doesn't break a span, but a passage
in another language becomes a span of its own.  The language of a text is the one with most letters.

The model is fitted on a sample of labelled rows of bounded expected size (`per_language` texts of
each language, chosen by a hash of the id); prediction covers every word of every text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .pieces import worker
from .textwords import as_bytes, slices

UNKNOWN = "und"
BUCKETS = 1 << 16
LONGEST_GRAM = 4
#: What a change of language costs, in units of a word's log-probability ratio.
PENALTY = 12.0
#: The score of a word in a language that isn't written in its script: no path takes it.
EXCLUDED = -1e6
#: Scores (words x languages) that a worker holds at once; a longer text is worked on in pieces, with one path.
HELD_SCORES = 1 << 24
#: Bytes of text whose words a worker holds at once, but for a longer text.
BATCH_BYTES = 1 << 20
#: A language is written in a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01

# First code points of script ranges, and scripts; letters elsewhere are "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"),
    (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x323B0, "other"),
)
SCRIPT_NAMES = sorted({s for _, s in SCRIPTS})
_FIRST = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(s) for _, s in SCRIPTS])


def letter_table() -> np.ndarray:
    return worker("letters", lambda: np.array([chr(i).isalpha() for i in range(0x323B0)]))


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _SCRIPT[np.searchsorted(_FIRST, points, side="right") - 1]


@dataclass
class Grams:
    """The letters and n-grams of some words: letters (and their scripts) and grams name the word."""

    letter_word: np.ndarray
    letter_script: np.ndarray
    gram_word: np.ndarray
    gram: np.ndarray


def grams_of(words: list[str], letters: np.ndarray) -> Grams:
    """n-grams of 1 to LONGEST_GRAM characters, hashed; what isn't a letter ends a word on both sides."""
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    word = np.cumsum(points == 10) - 1
    inside = letters[np.minimum(points, len(letters) - 1)]
    code = np.where(inside, points, 0).astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero(inside)
    hashes, owners = [], []
    value = np.zeros(len(points), np.uint64)
    good = np.ones(len(points), bool)
    for n in range(1, LONGEST_GRAM + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n > 2:
            good = good[:m] & inside[n - 2 : n - 2 + m]
        chosen = np.flatnonzero(inside) if n == 1 else np.flatnonzero(good[:m] & (inside[:m] | inside[n - 1 :]))
        h = (value[chosen] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        hashes.append((h >> np.uint64(48)).astype(np.int64))
        # a gram that begins in front of a word belongs to the word after it
        owners.append(np.where(inside[chosen], word[chosen], word[np.minimum(chosen + 1, len(points) - 1)]))
    return Grams(word[at], scripts_of(points[at]), np.concatenate(owners), np.concatenate(hashes))


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # language x bucket, log-probabilities
    written: np.ndarray  # language x script

    def score(self, words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores (word x language, the best is 0) and numbers of letters."""
        g = grams_of(words, letters)
        n = len(words)
        count = np.bincount(g.letter_word, minlength=n)[:n]
        script = np.full(n, -1, np.int64)
        script[g.letter_word[::-1]] = g.letter_script[::-1]  # that of the first letter
        total = np.zeros((n, len(self.names)))
        for kind in np.unique(script[script >= 0]):
            own, able = np.flatnonzero(script == kind), self.written[:, kind]
            if not able.any():
                continue  # no language is written so: the word says nothing
            total[np.ix_(own, np.flatnonzero(~able))] = EXCLUDED
            if able.sum() > 1:
                chosen = script[g.gram_word] == kind
                grams, owner = g.gram[chosen], g.gram_word[chosen]
                for k in np.flatnonzero(able):
                    total[own, k] = 0.5 * np.bincount(owner, weights=self.weights[k][grams], minlength=n)[own]
        total -= total.max(1, keepdims=True, initial=EXCLUDED)
        return total.astype(np.float32), count


def bucket_sums(texts, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each n-gram and script occurs in some texts."""
    grams, scripts = np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)
    for text in texts:
        words = (text or "").lower().split()
        for at in range(0, len(words), 100_000):
            g = grams_of(words[at : at + 100_000], letters)
            grams += np.bincount(g.gram, minlength=BUCKETS)
            scripts += np.bincount(g.letter_script, minlength=len(SCRIPT_NAMES))
    return grams, scripts


def train(docs: DataFrame, training: Column, per_language: int = 1000) -> Model:
    """Fits the model on rows where `training` holds and lang isn't null.

    The rows of each language are counted; then each row takes part with the probability that gives
    per_language rows on average, by a hash of its id.  All languages are learned, however many: the driver
    gets one row of sums for each of them, and the model holds 256 KB for each."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & training)
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros((0, len(SCRIPT_NAMES)), bool))
    names = sorted(counts)
    share = docs.sparkSession.createDataFrame([(n, min(1.0, per_language / counts[n])) for n in names], "lang string, share double")
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(share), "lang").where(place < F.col("share")).select("lang", "text")
    number = {n: i for i, n in enumerate(names)}
    parts = 32
    width = BUCKETS // parts

    def count(batches):
        letters = letter_table()
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = bucket_sums([text], letters)
                sums[lang] = [a + b for a, b in zip(sums[lang], found)] if lang in sums else list(found)
        for lang, (grams, scripts) in sums.items():
            blocks = [number[lang] * (parts + 1) + i for i in range(parts + 1)]
            raws = [x.tobytes() for x in np.split(grams, parts)] + [np.pad(scripts, (0, width - len(scripts))).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(raws, pa.binary())], ["block", "sums"])

    blocks = len(names) * (parts + 1)
    total = common.added_blocks(sample.mapInArrow(count, "block int, sums binary"), blocks * width, blocks).reshape(len(names), parts + 1, width)
    grams, scripts = total[:, :parts].reshape(len(names), BUCKETS), total[:, parts, : len(SCRIPT_NAMES)]
    weights = np.log(grams + 0.5) - np.log(grams.sum(1, keepdims=True) + 0.5 * BUCKETS)
    written = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))
    return Model(names, weights.astype(np.float32), written)


class Labeler:
    """A model with a cache of scored words; one for each worker."""

    def __init__(self, model: Model):
        self.model, self.letters = model, letter_table()
        self.piece = max(1024, min(1 << 18, HELD_SCORES // max(1, len(model.names))))
        self.room = max(20_000, min(200_000, 4_000_000 // max(1, len(model.names))))
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.names)), np.float32)
        self.counts = np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.number))
        if len(self.number) + len(new) > self.room:
            self.forget()
            new = list(set(words))
        if new:
            scores, counts = self.model.score(new, self.letters)
            self.number.update(zip(new, range(len(self.counts), len(self.counts) + len(new))))
            self.scores, self.counts = np.concatenate((self.scores, scores)), np.concatenate((self.counts, counts))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text the language number and the number of letters of each word."""
        cut = [(t or "").lower().split() for t in texts]
        if sum(map(len, cut)) > self.piece:
            # long texts, and many short ones, are held one after another
            both = [self.long(c) if len(c) > self.piece else self.short([c]) for c in cut]
            return [p for paths, _ in both for p in paths], [c for _, counts in both for c in counts]
        return self.short(cut)

    def short(self, cut: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        sizes = np.array([len(c) for c in cut])
        numbers = self.numbers(list(chain.from_iterable(cut)))
        first = np.concatenate(([0], np.cumsum(sizes)))
        scores, counts = self.scores[numbers], self.counts[numbers]
        paths: list[np.ndarray] = [np.zeros(n, np.int16) for n in sizes]
        mixed = []
        for i in np.flatnonzero(sizes):
            total = scores[first[i] : first[i + 1]].sum(0, dtype=np.float64)
            best = int(total.argmax())
            # the best score of any path is at most 0, less a penalty if it changes the language
            if total[best] >= -PENALTY:
                paths[i][:] = best
            else:
                mixed.append(i)
        if mixed:
            for i, path in zip(mixed, viterbi(scores, first[mixed], sizes[mixed])):
                paths[i] = path
        return paths, [counts[first[i] : first[i + 1]] for i in range(len(cut))]

    def long(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The path of one long text.  Scores are made for one piece at a time; what is kept of a word is the
        best language before it, and a bit for each language that says whether to come from there."""
        value, came, moved, counts = None, [], [], []
        for at in range(0, len(words), self.piece):
            numbers = self.numbers(words[at : at + self.piece])
            scores = self.scores[numbers]
            counts.append(self.counts[numbers])
            best, jumped = np.zeros(len(scores), np.int16), np.zeros(scores.shape, bool)
            for t, row in enumerate(scores):
                if value is None:
                    value = row.copy()
                    continue
                best[t] = value.argmax()
                jump = value[best[t]] - PENALTY
                jumped[t] = value < jump
                value = np.maximum(value, jump) + row
            value -= value.max()  # so that sums of millions of words stay exact
            came.append(best)
            moved.append(np.packbits(jumped, axis=1))
        path, now = np.zeros(len(words), np.int16), int(value.argmax())
        for k in range(len(came) - 1, -1, -1):
            jumped = np.unpackbits(moved[k], axis=1, count=len(value)).astype(bool)
            for t in range(len(came[k]) - 1, -1, -1):
                path[k * self.piece + t] = now
                if jumped[t, now]:
                    now = int(came[k][t])
        return [path], [np.concatenate(counts)]


def viterbi(scores: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The best paths for several texts in step: text i has the rows first[i] on, sizes[i] of them."""
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    longest, n_lang = int(sizes[0]), scores.shape[1]
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts longer than t
    offset = np.concatenate(([0], np.cumsum(active)))
    moved = np.zeros((int(offset[-1]), n_lang), bool)
    came = np.zeros(int(offset[-1]), np.int16)
    value = scores[first].astype(np.float32)
    last = np.zeros(len(sizes), np.int16)
    for t in range(1, longest):
        n = active[t]
        if n < len(value):
            last[n : len(value)] = value[n:].argmax(1)
            value = value[:n]
        best = value.argmax(1)
        jump = value[np.arange(n), best] - PENALTY
        better = value < jump[:, None]
        moved[offset[t] : offset[t] + n] = better
        came[offset[t] : offset[t] + n] = best
        value = np.where(better, jump[:, None], value) + scores[first[:n] + t]
    last[: len(value)] = value.argmax(1)
    out = np.zeros(int(offset[-1]), np.int16)
    now = last.copy()
    for t in range(longest - 1, -1, -1):
        n = active[t]
        out[offset[t] : offset[t] + n] = now[:n]
        if t:
            jumped = moved[offset[t] : offset[t] + n][np.arange(n), now[:n]]
            now[:n] = np.where(jumped, came[offset[t] : offset[t] + n], now[:n])
    paths: list[np.ndarray] = [np.zeros(0, np.int16)] * len(sizes)
    for i, k in enumerate(order):
        paths[k] = out[offset[: sizes[i]] + i]
    return paths


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (the share of letters in that language) and spans (start and end word,
    end exclusive, and language) of every document.

    A text that is null or has no letter is "und" with score 0 and no span, and so is every text if
    nothing was learned.  Of languages with equally many letters the first by name is given.  Repeated
    rows and null ids give a row each; columns other than doc_id and text are ignored.  Very long texts are
    labelled whole, in pieces that share one path.  Empty tables give no row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = f"labeler {uuid.uuid4().hex}"

    def find(batches):
        labeler = worker(token, lambda: Labeler(shared.value))
        names = shared.value.names
        struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            for i, j in slices(as_bytes(batch.column(1))[0], BATCH_BYTES):
                part = batch.slice(i, j - i)
                pred, score, spans = [], [], []
                texts = part.column(1).to_pylist()
                for path, counts in zip(*labeler.label(texts)) if names else (((), ()) for _ in texts):
                    total = np.bincount(path, weights=counts, minlength=len(names)) if len(path) else np.zeros(1)
                    if not total.sum():
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        spans.append([])
                        continue
                    best = int(total.argmax())
                    pred.append(names[best])
                    score.append(float(total[best] / total.sum()))
                    edges = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1, [len(path)])).tolist()
                    spans.append([{"start": a, "end": b, "lang": names[path[a]]} for a, b in zip(edges, edges[1:])])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, struct)], ["doc_id", "lang_pred", "score", "spans"])

    return common.documents(docs).mapInArrow(find, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")


def recognised(docs: DataFrame, model: Model, share: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, with a language that has at least `share` of their
    letters.  A document is judged where it is read, by its whole text; nothing is shuffled.

    A null text, or one without letters, goes; so do all if nothing was learned.  Repeated rows and rows
    without an id are judged each by its own text.  Very long texts are worked on in pieces.  Empty tables give
    no row, and no column of docs clashes, as none is added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    token = f"labeler {uuid.uuid4().hex}"

    def keep(batches):
        labeler = worker(token, lambda: Labeler(shared.value))
        n = len(shared.value.names)
        for batch in batches:
            for a, b in slices(as_bytes(batch.column("text"))[0], BATCH_BYTES):
                part = batch.slice(a, b - a)
                good = [False] * part.num_rows
                if n:
                    for i, (path, counts) in enumerate(zip(*labeler.label(part.column("text").to_pylist()))):
                        total = np.bincount(path, weights=counts, minlength=n) if len(path) else np.zeros(n)
                        good[i] = bool(total.sum() and total.max() >= share * total.sum())
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
