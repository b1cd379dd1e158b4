"""Phrases that are said together: contiguous pattern growth over the words of every language.

Texts are cut into pieces and these into words; a phrase lies within a piece.  Every occurrence of a word is a pointer to it and what
follows, up to the length of a phrase.  Equal pointers of a stretch of text are counted where they are, and all pointers of a prefix
go to one task, which grows it to the right depth-first: the pointers of a prefix are a range of sorted ones, their next words cut the range into those of
the longer prefixes, and those that are frequent are grown in turn.  A prefix with more than its share of all
words is no task of its own: its pointers are dealt out by the prefix one word longer, and counts of the short one are summed.  These heavy prefixes
are found beforehand in the same stretches; there are at most two for every shuffle partition and length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .textwords import as_bytes, slices

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
#: Text that is turned into words at once.
STRETCH = 8 << 20

_plain = bytearray(range(256))
_plain[65:91] = range(97, 123)
for _c in SEPARATORS:
    _plain[_c] = ord(".")
_plain[9] = 32
_plain = bytes(_plain)


def stretches(data: bytes, follow: int, limit: int = STRETCH) -> Iterator[tuple[list[bytes], int]]:
    """The words of plain bytes (ends of pieces are a full stop) in lists, each with how many of them are its own: up
    to `follow` words after these are there to be looked at.  Cuts are between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        if end < len(data):
            found = data.find(b" ", end), data.find(b".", end)
            end = min((x for x in found if x >= 0), default=len(data))
        own = data[at:end].replace(b".", b" . ").split()
        after: list[bytes] = []
        reach = 1 << 10
        while end < len(data) and len(after) <= follow:
            after = data[end : end + reach].replace(b".", b" . ").split()
            if end + reach >= len(data):
                break
            reach *= 4
        # the last word looked at may be cut, unless all that is left was seen
        if len(after) > follow:
            after = after[:follow]
        yield own + after, len(own)
        at = end


class Pointers:
    """The distinct pointers of one stretch, sorted: words are numbers (0: none), columns[j] is the word at place j."""

    def __init__(self, words: list[bytes], own: int, length: int):
        known: dict[bytes, int] = defaultdict(count().__next__)
        known[b"."]  # the end of a piece is 0
        ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.known, v = known, len(known)
        padded = np.concatenate((ids, np.zeros(length, np.int64)))
        first = padded[:own]
        at = np.flatnonzero(first)
        self.n = len(at)
        cols, alive = [first[at]], np.ones(len(at), bool)
        for j in range(1, length):
            nxt = padded[at + j] * alive
            alive = nxt > 0
            cols.append(nxt)
        # two words in one number: fewer than 2^31 words are in a stretch
        keys = [cols[j] * v + cols[j + 1] if j + 1 < length else cols[j] for j in range(0, length, 2)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        new[:1] = True
        for key in keys:
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        kept = order[starts]
        self.counts = np.diff(np.append(starts, len(at)))
        self.columns = [c[kept] for c in cols]

    def runs(self, k: int) -> np.ndarray:
        """Where the first k words are others than before."""
        new = np.zeros(len(self.counts), bool)
        new[:1] = True
        for c in self.columns[:k]:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def spelled(self) -> pa.Array:
        words = list(self.known)
        words[0] = b""
        return pa.array(words, pa.binary()).cast(pa.string())


def _by_language(batch: pa.RecordBatch, stretch: int) -> Iterator[tuple[str, bytes]]:
    """Language and plain bytes of the texts of some rows, in slices."""
    offsets, data = as_bytes(batch.column(1))
    for i, j in slices(offsets, stretch):
        held: dict[str, list[bytes]] = defaultdict(list)
        for lang, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), offsets[i:j], offsets[i + 1 : j + 1]):
            held[lang].append(data[a:b].tobytes().translate(_plain))
        for lang, texts in held.items():
            yield lang, b".".join(texts)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def heavy_prefixes(texts: DataFrame, length: int, parts: int, stretch: int = STRETCH) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The number of words of each language, and (language, prefix) of the heavy ones: those with more than 1 / (2 parts) of all words.

    A stretch tells what has 1 / (4 parts) of its own words, so nothing with 3 / (4 parts) of all is missed, and no
    more than 2 parts prefixes of a length are heavy."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, prefixes, counts = [], [], []
            for lang, data in _by_language(batch, stretch):
                for words, own in stretches(data, length - 1, stretch):
                    p = Pointers(words, own, length)
                    if not p.n:
                        continue
                    langs.append(lang)
                    prefixes.append(None)
                    counts.append(p.n)
                    least = max(2, p.n // (4 * parts))
                    spelled = list(p.known)
                    for k in range(1, length):
                        starts = p.runs(k)
                        sums = np.add.reduceat(p.counts, starts)
                        for i in np.flatnonzero((sums >= least) & (p.columns[k - 1][starts] > 0)):
                            langs.append(lang)
                            prefixes.append(b" ".join(spelled[p.columns[j][starts[i]]] for j in range(k)).decode())
                            counts.append(int(sums[i]))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(prefixes, pa.string()), pa.array(counts, pa.int64())], ["lang", "prefix", "n"])

    found = texts.mapInArrow(find, "lang string, prefix string, n long").groupBy("lang", "prefix").agg(F.sum("n").alias("n"))
    found = common.staged(found, "prefixes")
    sizes = found.where("prefix is null").select("lang", "n")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    heavy = found.where(F.col("prefix").isNotNull() & (F.col("n") * (2 * parts) > total)).select("lang", "prefix").collect()
    return sizes, [(x.lang, x.prefix) for x in heavy]


def _projected(texts: DataFrame, heavy: list[tuple[str, str]], length: int, stretch: int) -> DataFrame:
    """lang, key (a prefix), hot (whether the key is a heavy prefix, so that this is a part of its pointers only), n (pointers),
    tails (lines of what follows the key: words up to the length, apart by spaces) and counts."""
    by_lang: dict[str, list[list[bytes]]] = defaultdict(list)
    for lang, prefix in heavy:
        by_lang[lang].append(prefix.encode().split(b" "))
    sent = texts.sparkSession.sparkContext.broadcast(dict(by_lang))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, data in _by_language(batch, stretch):
                for words, own in stretches(data, length - 1, stretch):
                    p = Pointers(words, own, length)
                    if p.n:
                        yield _rows(lang, p, sent.value.get(lang, []), length)

    return texts.mapInArrow(project, "lang string, key string, hot boolean, n long, tails string, counts binary")


def _rows(lang: str, p: Pointers, heavy: list[list[bytes]], length: int) -> pa.RecordBatch:
    """The pointers of a stretch, those of one key in a row."""
    n = len(p.counts)
    depth, hot = np.ones(n, np.int64), np.zeros(n, bool)
    known = [h for h in heavy if all(w in p.known for w in h)]
    for k in range(1, length):
        own = {tuple(p.known[w] for w in h) for h in known if len(h) == k}
        if not own:
            break
        starts = p.runs(k)
        # of prefixes of k - 1 words only heavy ones can have heavy longer ones
        maybe = np.flatnonzero(np.isin(p.columns[0][starts], [h[0] for h in own]) & np.isin(p.columns[k - 1][starts], [h[-1] for h in own]))
        ends = np.append(starts[1:], n)
        for i in maybe:
            if tuple(int(p.columns[j][starts[i]]) for j in range(k)) in own:
                a, b = starts[i], ends[i]
                on = p.columns[k][a:b] > 0
                depth[a:b][on] = k + 1
                hot[a:b][~on] = True
    new = np.zeros(n, bool)
    new[:1] = True
    new[1:] = depth[1:] != depth[:-1]
    for j, c in enumerate(p.columns):
        new[1:] |= (c[1:] != c[:-1]) & (depth[1:] > j)
    starts = np.flatnonzero(new)
    spelled = p.spelled()
    word = lambda ids: pc.take(spelled, pa.array(ids))
    zero = np.zeros(n, np.int64)
    tail = []
    for j in range(1, length):
        # the j-th word after the key
        ids = zero.copy()
        for d in range(1, length - j + 1):
            ids = np.where(depth == d, p.columns[d + j - 1], ids)
        tail.append(word(ids))
    lines = pc.binary_join_element_wise(*tail, " ")
    ends = np.append(starts, n).astype(np.int32)
    tails = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), lines), "\n")
    at = depth[starts]
    keys = word(p.columns[0][starts])
    for j in range(1, length):
        longer = pc.binary_join_element_wise(keys, word(np.where(at > j, p.columns[j][starts], 0)), " ")
        keys = pc.if_else(pa.array(at > j), longer, keys)
    counts = p.counts.astype("<i8")
    raw = [counts[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
    columns = [pa.array([lang] * len(starts), pa.string()), keys, pa.array(hot[starts]), pa.array(np.add.reduceat(p.counts, starts)), tails, pa.array(raw, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "key", "hot", "n", "tails", "counts"])


def bound(a: int, before: list[int | None]) -> int:
    """No score of a phrase that occurs a times is greater: what comes after a cut occurs a times at least, and
    before has the counts of what comes before, where they are known."""
    return min((2_000_000 * a // (l + a) for l in before if l is not None), default=1_000_000)


def _grown(prefix: str, counts: list[int | None], ids: np.ndarray, times: np.ndarray, words: list[str], none: int, least: int) -> Iterator[tuple[str, int, int]]:
    """(phrase, count, bound) of the frequent phrases longer than a prefix, depth-first, from its sorted pointers: ids are the
    words at each place after it.  counts are those of the prefix's own beginnings, itself the last."""
    todo = [(prefix, counts, 0, len(ids), 0)]
    while todo:
        own, before, a, b, j = todo.pop()
        column = ids[a:b, j]
        starts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        sums = np.add.reduceat(times[a:b], starts)
        ends = np.append(starts[1:], b - a)
        for i in np.flatnonzero((sums >= least) & (column[starts] != none)):
            phrase, n = f"{own} {words[column[starts[i]]]}", int(sums[i])
            yield phrase, n, bound(n, before)
            if j + 1 < ids.shape[1]:
                todo.append((phrase, [*before, n], a + int(starts[i]), a + int(ends[i]), j + 1))


FOUND = "lang string, phrase string, f long, bound long"


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "phrase", "f", "bound"])


def _grow_all(rows: pa.Table, length: int, least: int, partial: dict[tuple[str, str], int]) -> list[tuple]:
    """What all prefixes of some sorted rows grow to.  Prefixes that aren't frequent are left out before their pointers are read."""
    lang, key = (rows.column(c).combine_chunks() for c in ("lang", "key"))
    n = len(key)
    if not n:
        return []
    other = lambda c: pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate(([True], other(lang) | other(key))))
    sizes = np.diff(np.append(starts, n))
    totals = np.add.reduceat(rows.column("n").to_numpy(), starts)
    hot = rows.column("hot").to_numpy()[starts]
    depth = pc.count_substring(key.take(pa.array(starts)), " ").to_numpy() + 1
    for g in np.flatnonzero(hot | (depth > 1)):
        own, said = lang[starts[g]].as_py(), key[starts[g]].as_py().split(" ")
        for j in range(1, len(said) + hot[g]):
            partial[own, " ".join(said[:j])] += int(totals[g])
    frequent = np.flatnonzero(~hot & (totals >= least))
    if not len(frequent):
        return []
    langs, keys = (c.take(pa.array(starts[frequent])).to_pylist() for c in (lang, key))
    totals, depth = totals[frequent].tolist(), depth[frequent]
    unknown = [[None] * (d - 1) for d in depth.tolist()]
    out = [(a, k, t, bound(t, u)) for a, k, t, u in zip(langs, keys, totals, unknown)]
    chosen = np.zeros(len(starts), bool)
    chosen[frequent] = True
    own = rows.filter(pa.array(np.repeat(chosen, sizes)))
    lines = pc.split_pattern(own.column("tails").combine_chunks(), "\n")
    group = np.repeat(np.repeat(np.arange(len(frequent)), sizes[frequent]), pc.list_value_length(lines).to_numpy())
    times = np.frombuffer(b"".join(own.column("counts").to_pylist()), "<i8")
    fields = pc.list_flatten(pc.split_pattern(pc.list_flatten(lines), " ")).dictionary_encode()
    words = fields.dictionary.to_pylist()
    none = words.index("") if "" in words else -1
    ids = fields.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length - 1)
    v = len(words)
    keys_of = [group * v + ids[:, 0], *(ids[:, j] * v + ids[:, j + 1] if j + 1 < length - 1 else ids[:, j] for j in range(1, length - 1, 2))]
    order = np.lexsort(keys_of[::-1])
    ids, times, group = ids[order], times[order], group[order]
    edges = np.searchsorted(group, np.arange(len(frequent) + 1))
    for g, (a, k, t, u) in enumerate(zip(langs, keys, totals, unknown)):
        room = length - int(depth[g])
        if room:
            i, j = edges[g], edges[g + 1]
            out.extend((a, *x) for x in _grown(k, [*u, t], ids[i:j, :room], times[i:j], words, none, least))
    return out


def frequent_phrases(texts: DataFrame, length: int, least: int, heavy: list[tuple[str, str]], parts: int, stretch: int = STRETCH, held_bytes: int = 16 << 20) -> DataFrame:
    """lang, phrase, f of all phrases of 1 to length words that occur `least` times or more, and bound (null: none is known), which
    no score of a phrase is beyond."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial: dict[tuple[str, str], int] = defaultdict(int)
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < held_bytes:
                continue
            # the last prefix may go on
            rows = pa.Table.from_batches(held)
            n = rows.num_rows
            last = pc.and_(pc.equal(rows.column("lang"), rows.column("lang")[n - 1]), pc.equal(rows.column("key"), rows.column("key")[n - 1]))
            whole = n - pc.sum(last).as_py()
            yield _table(_grow_all(rows.slice(0, whole), length, least, partial))
            held = rows.slice(whole).to_batches()
            # its own size doesn't count: a prefix that is larger than all is read to its end
            size = 0
        if held:
            yield _table(_grow_all(pa.Table.from_batches(held), length, least, partial))
        yield _table([(*k, n, None) for k, n in partial.items()])

    placed = _projected(texts, heavy, length, stretch).repartition(parts, "lang", "key").sortWithinPartitions("lang", "key")
    found = placed.mapInArrow(grow, FOUND)
    # counts of a heavy prefix come from many tasks
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"), F.min("bound").alias("bound")).where(F.col("f") >= least)


def _exact(column) -> str:
    return f"cast({column} as decimal(20, 0))"


def collocations(docs: DataFrame, length: int = 4, least: int = 30, inside: int = 80, best: int | None = 2000, parts: int | None = None, stretch: int = STRETCH, block: int = 16) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to length words of each language whose words are most
    at home in one another's company.

    a counts the phrase, l and r its parts at the cut with the least score floor(2000000 a / (l + r)), n all words of the
    language.  A phrase that is `inside` per cent or more of the time part of one longer candidate is left out.  Of each
    language the `best` first by score, count and phrase are returned (None: all).

    A null text has no words and a null language is `und`.  Repeated rows count each time.  Empty tables give no row; other
    columns are ignored.  Texts are read whole, a long one in stretches; what a prefix task holds is at most a heavy prefix's
    worth of pointers, of which copies in one stretch are one."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _texts(docs)
    sizes, heavy = heavy_prefixes(texts, length, parts, stretch)
    known = common.staged(frequent_phrases(texts, length, least, heavy, parts, stretch), "phrases")
    words = F.split("phrase", " ")
    candidates = known.select("lang", "phrase", F.col("f").alias("a"), F.coalesce("bound", F.lit(1_000_000)).alias("bound"), words.alias("w"), F.size(words).alias("k")).where("k >= 2")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    place = F.row_number().over(order).cast("long")
    if best is None:
        scored = _scored(common.staged(candidates, "candidates"), candidates, known, inside)
    else:
        # those with the greatest bounds are scored first; the others only if their bound reaches what the last of the best has
        first = Window.partitionBy("lang").orderBy(F.desc("bound"), F.desc("a"), "phrase")
        tried = common.staged(candidates.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= block * best).drop("_n"), "tried")
        scored = common.staged(_scored(tried, candidates, known, inside), "scored")
        needed = common.staged(scored.withColumn("_n", place).where(F.col("_n") == best).select("lang", F.col("score").alias("_score"), F.col("a").alias("_a")), "needed")
        # a language with fewer has no such bound, and all its phrases are scored
        open_ = candidates.join(F.broadcast(needed) if common.few(needed) else needed, "lang", "left").where("_score is null or bound > _score or (bound = _score and a >= _a)")
        rest = common.staged(open_.drop("_score", "_a").join(tried.select("lang", "phrase"), ["lang", "phrase"], "left_anti"), "rest")
        if not rest.isEmpty():
            scored = scored.unionByName(_scored(rest, candidates, known, inside))
    ranked = scored.withColumn("rank", place)
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _scored(chosen: DataFrame, longer: DataFrame, known: DataFrame, inside: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the chosen candidates (a written table) that aren't part of one of `longer` too often."""
    own = chosen.select("lang", "phrase")
    within = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    parts = longer.where("k >= 3").select("lang", F.explode(F.expr(within)).alias("phrase"), "a")
    asked = F.broadcast(own) if common.few(own) else own
    longest = parts.join(asked, ["lang", "phrase"], "left_semi").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = chosen.join(longest, ["lang", "phrase"], "left").where(f"longest is null or 100 * {_exact('longest')} < {inside} * {_exact('a')}").drop("longest")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("transform(sequence(1, k - 1), i -> struct(i as cut, array_join(slice(w, 1, i), ' ') as left, array_join(slice(w, i + 1, k - i), ' ') as right))")).alias("c"))
    cuts = common.staged(cuts.select("lang", "phrase", "a", "c.cut", "c.left", "c.right"), "cuts")
    # of the known phrases only those that are a part of a chosen one
    asked = common.staged(cuts.select("lang", F.explode(F.array("left", "right")).alias("phrase")).distinct(), "parts")
    counts = common.staged(known.select("lang", "phrase", "f").join(F.broadcast(asked) if common.few(asked) else asked, ["lang", "phrase"], "left_semi"), "counts")
    both = common.looked_up(cuts, counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    both = common.looked_up(both, counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast(2000000 as decimal(10, 0)) * {_exact('a')}) div ({_exact('l')} + {_exact('r')})")
    least_cut = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("c"))
    return least_cut.select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
