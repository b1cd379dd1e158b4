"""Benchmark contamination by a prefix-filtered set join over item-sized windows.

Every window of an item (13 consecutive words, or the whole of a shorter item) is a set of shingles.
A document that contains the window contains all of them, so it is enough to join one necessary
shingle of each window: the rarest one in the corpus.  The steps:

1. one pass counts how often each shingle of the benchmark occurs in all documents;
2. in every window the shingles are ordered by those counts and the rarest is its prefix;
3. a second pass finds prefix shingles in the documents.  A match at word p for a prefix at place q
   of a window of n words puts the window at p - q, which must lie inside the document (the bounds
   on position and length), and there all its n words must be equal: first by their hashes, and then
   letter by letter (the exact check).

The benchmark's windows are broadcast in blocks of at most `block_words` words and an item, one pass for
each block, so what is broadcast stays within a fixed size however large the benchmark is; of several blocks
the driver holds one at a time, and what each hits is written.  Documents are never shuffled unless there
are several blocks, and then only what was hit.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textwords import Words, alphanumeric_words, as_bytes, shingles, slices, words_of

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
_FILTER_BITS = 22


@dataclass
class Windows:
    """The distinct windows of some items.  words[at[i] : at[i] + size[i]] are the hashes of window i's words,
    and spelled has the words themselves, a space behind each, word k from spelled_at[k] on;
    owners[owner_at[i] : owner_at[i + 1]] are the numbers of the items that it belongs to."""

    words: np.ndarray
    spelled: bytes
    spelled_at: np.ndarray
    at: np.ndarray
    size: np.ndarray
    owners: np.ndarray
    owner_at: np.ndarray
    item_ids: list

    def text(self, i: int) -> bytes:
        return self.spelled[self.spelled_at[self.at[i]] : self.spelled_at[self.at[i] + self.size[i]] - 1]

    def width(self, i: int) -> int:
        return min(SHINGLE_WORDS, int(self.size[i]))

    def shingles(self) -> dict[int, np.ndarray]:
        """By width, the distinct shingles of all windows, sorted."""
        out = {}
        for width in sorted({self.width(i) for i in range(len(self.at))}):
            chosen = [shingles(self.words[a : a + n], width) for i, (a, n) in enumerate(zip(self.at, self.size)) if self.width(i) == width]
            out[width] = np.unique(np.concatenate(chosen))
        return out


def item_blocks(items: DataFrame, block_words: int):
    """The items, read in order of their ids, in blocks of about block_words words."""
    block: list[tuple[int, np.ndarray, list[bytes]]] = []
    held = 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        offsets, data = as_bytes(pa.array([row.text]))
        hashes = words_of(offsets, data, alphanumeric_words()).hash
        if len(hashes):
            block.append((row.item_id, hashes, spelling(data.tobytes()).split(b" ")))
            held += len(hashes)
        if held >= block_words:
            yield windows_of(block)
            block, held = [], 0
    if block:
        yield windows_of(block)


def windows_of(items: list[tuple[int, np.ndarray, list[bytes]]]) -> Windows:
    words = np.concatenate([h for _, h, _ in items])
    every = [x for _, _, spelled in items for x in spelled]
    spelled_at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in every])))
    ids = sorted({i for i, _, _ in items}, key=str)
    number = {x: k for k, x in enumerate(ids)}
    found: dict[bytes, tuple[int, int, set]] = {}
    start = 0
    for item_id, h, spelled in items:
        n = min(WINDOW_WORDS, len(h))
        for j in range(len(h) - n + 1):
            found.setdefault(b" ".join(spelled[j : j + n]), (start + j, n, set()))[2].add(number[item_id])
        start += len(h)
    at, size, owners = (list(x) for x in zip(*found.values()))
    flat = np.array([o for s in owners for o in sorted(s)], np.int64)
    return Windows(words, b" ".join(every) + b" ", spelled_at, np.array(at), np.array(size), flat, np.concatenate(([0], np.cumsum([len(s) for s in owners]))), ids)


#: Letters in lower case, and a space for all that stands between words.
_SPELL = bytes((i + 32 if 65 <= i < 91 else i) if inside else 32 for i, inside in enumerate(alphanumeric_words().tolist()))


def spelling(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_SPELL).split())


class Finder:
    """Finds where shingles of given widths occur in a slice of documents."""

    def __init__(self, wanted: dict[int, np.ndarray]):
        self.wanted = wanted
        self.seen = {}
        for width, keys in wanted.items():
            self.seen[width] = np.zeros(1 << _FILTER_BITS, bool)
            self.seen[width][(keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def matches(self, w: Words):
        """For each width: it, the word positions and the numbers of the shingles found there."""
        for width, keys in self.wanted.items():
            s = shingles(w.hash, width)
            at = np.flatnonzero(self.seen[width][(s >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            number = np.minimum(np.searchsorted(keys, s[at]), len(keys) - 1)
            good = keys[number] == s[at]
            at, number = at[good], number[good]
            good = w.doc[at] == w.doc[at + width - 1]
            yield width, at[good], number[good]


def shingle_counts(docs: DataFrame, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often the wanted shingles occur in all documents."""
    length = sum(map(len, wanted.values()))
    parts = max(1, length >> 16)
    padded = -(-length // parts) * parts
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches):
        finder, table = Finder(shared.value), alphanumeric_words()
        first = dict(zip(shared.value, np.concatenate(([0], np.cumsum([len(k) for k in shared.value.values()])))))
        counts = np.zeros(padded, np.int64)
        for batch in batches:
            offsets, data = as_bytes(batch.column(0))
            for i, j in slices(offsets):
                w = words_of(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], table)
                for width, _, number in finder.matches(w):
                    np.add.at(counts, number + first[width], 1)
        yield common.blocks_of(counts, parts)

    total = common.added_blocks(common.documents(docs).select("text").mapInArrow(count, "block int, sums binary"), padded, parts)
    out, at = {}, 0
    for width, keys in wanted.items():
        out[width] = total[at : at + len(keys)]
        at += len(keys)
    return out


class Search:
    """The windows of a block, each under the rarest of its shingles."""

    def __init__(self, windows: Windows, counts: dict[int, np.ndarray]):
        self.windows = windows
        wanted = windows.shingles()
        self.prefixes: dict[int, np.ndarray] = {}
        self.holds: dict[int, list[list[tuple[int, int]]]] = {}
        chosen: dict[int, dict[int, list[tuple[int, int]]]] = {width: {} for width in wanted}
        for i in range(len(windows.at)):
            width = windows.width(i)
            own = shingles(windows.words[windows.at[i] : windows.at[i] + windows.size[i]], width)
            number = np.searchsorted(wanted[width], own)
            rarest = int(np.lexsort((own, counts[width][number]))[0])
            chosen[width].setdefault(int(own[rarest]), []).append((i, rarest))
        for width, by in chosen.items():
            keys = np.array(sorted(by), np.uint64)
            self.prefixes[width], self.holds[width] = keys, [by[int(k)] for k in keys]
        self.finder = Finder(self.prefixes)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows found in a slice: the first word of each, its window, its document."""
        first, window = [], []
        v = self.windows
        for width, at, number in self.finder.matches(w):
            for p, k in zip(at.tolist(), number.tolist()):
                doc = w.doc[p]
                for i, place in self.holds[width][k]:
                    start, n = p - place, int(v.size[i])
                    if start < w.first[doc] or start + n > w.first[doc + 1] or not np.array_equal(w.hash[start : start + n], v.words[v.at[i] : v.at[i] + n]):
                        continue
                    if spelling(w.data[w.start[start] : w.end[start + n - 1]].tobytes()) == v.text(i):
                        first.append(start)
                        window.append(i)
        first = np.array(first, np.int64)
        return first, np.array(window, np.int64), w.doc[first]


_SCHEMA = "doc_id long, text_sha string, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _found(docs: DataFrame, search, several: bool = False) -> DataFrame:
    """For every document: n_words, the spans of words hit (merged, from the first word on) and the
    items found.  search is a broadcast Search or None; text_sha is there if there are several blocks."""

    def find(batches):
        table = alphanumeric_words()
        for batch in batches:
            offsets, data = as_bytes(batch.column(1))
            for i, j in slices(offsets):
                low = offsets[i]
                w = words_of(offsets[i : j + 1] - low, data[low : offsets[j]], table)
                spans: list[list] = [[] for _ in range(j - i)]
                items: list[list] = [[] for _ in range(j - i)]
                if search is not None and len(w):
                    s = search.value
                    first, window, doc = s.hits(w)
                    for d in np.unique(doc):
                        own = doc == d
                        starts, sizes = first[own] - w.first[d], s.windows.size[window[own]]
                        for a, n in sorted(zip(starts.tolist(), sizes.tolist())):
                            if spans[d] and a <= spans[d][-1]["end"]:
                                spans[d][-1]["end"] = max(spans[d][-1]["end"], a + n)
                            else:
                                spans[d].append({"start": a, "end": a + n})
                        owned = {int(o) for k in np.unique(window[own]) for o in s.windows.owners[s.windows.owner_at[k] : s.windows.owner_at[k + 1]]}
                        items[d] = [s.windows.item_ids[o] for o in sorted(owned)]
                raw = memoryview(data)
                sha = [hashlib.sha256(raw[offsets[r] : offsets[r + 1]]).hexdigest() for r in range(i, j)] if several else [None] * (j - i)
                struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sha, pa.string()), pa.array(np.diff(w.first), pa.int64()), pa.array(spans, struct), pa.array(items, pa.list_(pa.int64()))],
                    ["doc_id", "text_sha", "n_words", "spans", "items"],
                )

    return common.documents(docs).mapInArrow(find, _SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, block_words: int = 2_000_000) -> DataFrame:
    """For every document: doc_id, n_words, n_hit, spans (word positions of what is hit, merged, end
    exclusive), items (ids of the items found, in the order of their spelling).

    A null text has no words and matches nothing; items without words, with a null id or text, match
    nothing.  An empty benchmark leaves all documents clean, an empty table gives no row.  Repeated
    documents give a row each, repeated items count once.  Other columns are ignored."""
    return _judged(docs, benchmark, block_words).select("doc_id", "n_words", "n_hit", "spans", "items")


def _first_block(benchmark: DataFrame, block_words: int):
    """(the block, None) if there is one at most, else (None, all blocks, made one after another)."""
    blocks = item_blocks(benchmark, block_words)
    first, second = next(blocks, None), next(blocks, None)
    return (first, None) if second is None else (None, chain((first, second), blocks))


def _search(docs: DataFrame, windows: Windows):
    return docs.sparkSession.sparkContext.broadcast(Search(windows, shingle_counts(docs, windows.shingles())))


def _judged(docs: DataFrame, benchmark: DataFrame, block_words: int) -> DataFrame:
    """contamination() with text_sha, which is null if there is one block of windows at most."""
    first, rest = _first_block(benchmark, block_words)
    if rest is None:
        found = _found(docs, _search(docs, first) if first else None)
    else:
        # every block has its pass; what it hits is small and meets at the document
        hit = None
        for windows in rest:
            search = _search(docs, windows)
            one = common.staged(_found(docs, search, several=True).where(F.size("items") > 0), "hits")
            search.destroy()
            hit = one if hit is None else hit.unionByName(one)
        joined = hit.groupBy("doc_id", "text_sha").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_set("items")).alias("items"))
        joined = joined.select(F.col("doc_id").alias("hit_id"), F.col("text_sha").alias("hit_sha"), F.col("spans").alias("hit_spans"), F.col("items").alias("hit_items"))
        every = _found(docs, None, several=True)
        both = every.join(joined, every.doc_id.eqNullSafe(joined.hit_id) & (every.text_sha == joined.hit_sha), "left")
        span = "array<struct<start:long,end:long>>"
        merged = F.aggregate(
            F.array_sort("hit_spans"),
            F.array().cast(span),
            lambda acc, x: F.when((F.size(acc) > 0) & (x.start <= F.element_at(acc, -1).end), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.element_at(acc, -1).start.alias("start"), F.greatest(F.element_at(acc, -1).end, x.end).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
        )
        ordered = F.transform(F.array_sort(F.transform(F.array_distinct("hit_items"), lambda i: F.struct(i.cast("string").alias("s"), i.alias("i")))), lambda x: x.i)
        found = both.select("doc_id", "text_sha", "n_words", F.coalesce(merged, F.array().cast(span)).alias("spans"), F.coalesce(ordered, F.array().cast("array<long>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x.end - x.start)
    return found.select("doc_id", "text_sha", "n_words", n_hit.alias("n_hit"), "spans", "items")


def contaminated(n_hit, n_words):
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = 2_000_000) -> DataFrame:
    """The documents, all columns as they are, without the contaminated ones.

    Null and empty texts have no words and stay; so does everything if no item has words.  Repeated rows and
    rows without an id are judged each by its own text, texts of any length whole.  Empty tables give no row.
    No column is added, so none clashes.

    With one block of windows a document is judged where it is read and nothing is shuffled.  With more
    of them the ids and digests of contaminated documents are joined, so that every row, also one whose
    id is null or shared, is judged by its own text all the same."""
    first, rest = _first_block(benchmark, block_words)
    if rest is None and first is None:
        return docs
    if rest is not None:
        verdict = _judged(docs, benchmark, block_words).where(contaminated(F.col("n_hit"), F.col("n_words")))
        verdict = verdict.select("doc_id", "text_sha").distinct()
        own_sha = F.sha2(F.coalesce(docs.text.cast("string"), F.lit("")), 256)
        return docs.join(verdict, docs.doc_id.cast("long").eqNullSafe(verdict.doc_id) & (own_sha == verdict.text_sha), "left_anti")
    shared = _search(docs, first)

    def keep(batches):
        table, search = alphanumeric_words(), shared.value
        for batch in batches:
            offsets, data = as_bytes(batch.column("text"))
            for i, j in slices(offsets):
                w = words_of(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], table)
                first, window, doc = search.hits(w)
                hit = np.zeros(len(w) + 1, np.int64)
                np.add.at(hit, first, 1)
                np.add.at(hit, first + search.windows.size[window], -1)
                covered = np.concatenate(([0], np.cumsum(np.cumsum(hit[:-1]) > 0)))
                n_hit, n_words = np.diff(covered[w.first]), np.diff(w.first)
                yield batch.slice(i, j - i).filter(pa.array(~((n_hit > 0) & (20 * n_hit >= n_words))))

    return docs.mapInArrow(keep, docs.schema)
