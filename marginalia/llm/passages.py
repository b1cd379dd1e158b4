"""Removing passages that repeat anywhere in the corpus.

A text is cut into units: a unit ends with a line feed or with the marks that end a sentence, so a
passage is found inside a longer line and over several lines as well.  Units are normalised (A to Z in
lower case, runs of white space as one space).  Each unit begins a form: itself and, while that has
fewer than `least` words, the units after it; the last words of a text are part of the form that ends
it.  Forms are hashed and their digests grouped over the whole corpus.  Of each the earliest occurrence,
by document and place, stays.  What all others cover is joined into runs, and a run of `words` words or
more goes; a shorter one may well be chance, and stays.

Words are told apart by spaces; in scripts that have none every character counts as one.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textwords import as_bytes, slices

ENDERS = r"\n.!?。！？"
#: Units: what leads up to an end, and the marks of the end.  They cover the whole text.
UNIT = rf"[^{ENDERS}]*[{ENDERS}]+|[^{ENDERS}]+"
#: Thai to Tibetan, Burmese, Khmer, Chinese and Japanese: scripts without spaces between words.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U000323af"
WORD = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"

_units = re.compile(UNIT).findall
_has_unspaced = re.compile(f"[{UNSPACED}]").search
_words = re.compile(WORD).findall
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def measured(text: str) -> tuple[list[str], list[bytes], list[int]]:
    """The units of a text, their normalised spellings and their numbers of words."""
    units = _units(text)
    cut = [u.encode().translate(_lower).split() for u in units]
    if text.isascii() or not _has_unspaced(text):
        return units, list(map(b" ".join, cut)), list(map(len, cut))
    return units, list(map(b" ".join, cut)), [len(_words(u)) for u in units]


def forms(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """(first unit, last unit + 1) of every form, each once.  A text of fewer than `least` words has none."""
    upto = [0]
    for n in sizes:
        upto.append(upto[-1] + n)
    if upto[-1] < least:
        return []
    end = len(sizes)
    while not sizes[end - 1]:
        end -= 1
    out, j = [], 0
    for i in range(end):
        if not sizes[i]:
            continue
        if upto[end] - upto[i] < least:
            first = i
            while upto[end] - upto[first] < least:
                first -= 1
            if out[-1] != (first, end):
                out.append((first, end))
            break
        j = max(j, i + 1)
        while upto[j] - upto[i] < least:
            j += 1
        out.append((i, j))
    return out


def runs(sizes: list[int], covered: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """(first unit, last unit + 1) of the runs of covered units, and of units without words, that have at
    least `words` words together."""
    inside = [not n for n in sizes]
    for a, b in covered:
        inside[a:b] = [True] * (b - a)
    out, at = [], 0
    while at < len(sizes):
        if not inside[at]:
            at += 1
            continue
        end, n = at, 0
        while end < len(sizes) and inside[end]:
            n += sizes[end]
            end += 1
        if n and n >= words:
            out.append((at, end))
        at = end
    return out


def digest(spelled: list[bytes], a: int, b: int) -> bytes:
    return hashlib.blake2b(spelled[a] if b == a + 1 else b" ".join(filter(None, spelled[a:b])), digest_size=16).digest()


def form_digests(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, first (unit) and digest of every form of documents that have an id."""

    def find(batches):
        for batch in batches:
            offsets, _ = as_bytes(batch.column(1))
            for i, j in slices(offsets):
                some = batch.slice(i, j - i)
                ids, firsts, digests = [], [], []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    _, spelled, sizes = measured(text)
                    for a, b in forms(sizes, least):
                        ids.append(doc_id)
                        firsts.append(a)
                        digests.append(digest(spelled, a, b))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(firsts, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "first", "digest"])

    named = common.documents(docs).where("doc_id is not null and text is not null")
    return named.mapInArrow(find, "doc_id long, first int, digest binary")


#: A digest is hot with more occurrences than LEAST_HOT and a thousandth of all that occur twice: there are no
#: more than a thousand.  Its rows are dealt out to SALTS keys.
LEAST_HOT, SALTS = 10_000, 256


def repeated_forms(docs: DataFrame, least: int = 6) -> DataFrame:
    """doc_id, first (unit) and digest of every form that has an earlier occurrence.

    Digests are counted in the tasks that make them before they are shuffled.  Only those that occur
    twice are written, and the forms are made a second time to meet them.  Rows of hot digests meet copies of
    their one row under several keys, so a digest of a third of all forms isn't one task."""
    hashed = form_digests(docs, least)
    first = hashed.groupBy("digest").agg(F.min(F.struct("doc_id", "first")).alias("earliest"), F.count("*").alias("n"))
    first = common.staged(first.where("n > 1"), "forms")
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = first.where(F.col("n") > max(LEAST_HOT, total // 1000)).select("digest", F.lit(True).alias("hot"))
    first = first.select("digest", "earliest")
    keys = ["digest"]
    if not hot.isEmpty():
        keys.append("salt")
        few = F.broadcast(hot)
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
        hashed = hashed.join(few, "digest", "left").withColumn("salt", salt).drop("hot")
        none = F.lit(0).cast("long")
        salts = F.when(F.col("hot"), F.sequence(none, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(none))
        first = first.join(few, "digest", "left").withColumn("salt", F.explode(salts)).drop("hot")
    again = hashed.join(first, keys).where("doc_id <> earliest.doc_id or first <> earliest.first")
    return again.select("doc_id", "first", "digest").distinct()


SCHEMA = "doc_id long, has_repeats boolean, n_removed long, n_words_removed long, removed array<struct<start:long,end:long>>, text string"


def without_passages(docs: DataFrame, words: int = 25, least: int = 6) -> DataFrame:
    """doc_id, has_repeats, n_removed (passages), n_words_removed, removed (their spans in code points of the
    original text, end exclusive) and text (what remains: the text without these spans).

    A null text stays null and loses nothing; nor does an empty one.  Rows without an id keep all and
    don't count for others.  Rows that repeat an id and a text are the same document and lose the same
    passages; of rows that share an id but not the text, what is equal at the same place counts once.  A
    text is worked on whole, whatever its length; long ones are taken one at a time.  Empty tables give no row;
    other columns are ignored."""
    docs = common.documents(docs)
    gone = repeated_forms(docs, least).groupBy("doc_id").agg(F.collect_list(F.struct("first", "digest")).alias("gone"))

    def cut(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            offsets, _ = as_bytes(batch.column(1))
            for i, j in slices(offsets):
                some = batch.slice(i, j - i)
                texts, removed, lost = [], [], []
                for text, gone in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                    found, n = [], 0
                    if gone and text:
                        units, spelled, sizes = measured(text)
                        wanted = {(g["first"], g["digest"]) for g in gone}
                        firsts = {first for first, _ in wanted}
                        # the digest tells rows apart that share an id
                        out = runs(sizes, [(a, b) for a, b in forms(sizes, least) if a in firsts and (a, digest(spelled, a, b)) in wanted], words)
                        if out:
                            at = [0]
                            for u in units:
                                at.append(at[-1] + len(u))
                            found = [{"start": at[a], "end": at[b]} for a, b in out]
                            n = sum(sum(sizes[a:b]) for a, b in out)
                            edges = [0, *(x for s in found for x in (s["start"], s["end"])), len(text)]
                            text = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    texts.append(text)
                    removed.append(found)
                    lost.append(n)
                cols = [some.column(0), pa.array([bool(x) for x in removed], pa.bool_()), pa.array(list(map(len, removed)), pa.int64()), pa.array(lost, pa.int64()), pa.array(removed, span), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "has_repeats", "n_removed", "n_words_removed", "removed", "text"])

    # rows without an id would meet in one task; they have nothing to meet there
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left").select("doc_id", "text", "gone")
    nameless = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"))
    return named.unionByName(nameless).mapInArrow(cut, SCHEMA)
