"""Near duplicates by a similarity join of shingle sets: links of Jaccard similarity at or above a
threshold, and the groups they form.

The join is a prefix filter with the rarest shingles first:

1. one pass hashes every text to its set of k-word shingles and gives equal sets one class; another counts
   all shingles of the corpus in a table, whose size follows the corpus within bounds (counts of shingles
   that share a cell add up);
2. shingles are ordered by that count, then by hash, the same way everywhere.  Two sets of sizes m
   and n can only be similar if they share one of their first n - ceil(t n) + 1 shingles, so only
   that prefix of each class is shuffled, by shingle; rows that no other class of their shingle can
   be similar to, by length and position, go at once;
3. in the join, a pair of classes must pass the filters of length, of position, and the suffix
   filter: the parities of both sets in 256 cells differ in no more cells than the sets may differ
   in shingles.  A pair is taken at its first common prefix shingle as far as the row shows it;
4. what is left is distinct pairs, each of which is verified once on the whole sets.

Large groups of near copies would still make a number of pairs that grows with their square.  So the
join runs twice.  First each class meets one hub for each of its prefix shingles, which is linear, and
verified links are merged.  Then the full join leaves out pairs that are already in one group: they
can't change it, so no group is lost or split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components
from .pieces import released
from .textwords import as_bytes, mix, shingle_sets, slices, whitespace_words, words_of

#: Cells of the table of counts: about one for every 16 shingles, and from 2 to the one to 2 to the other.
LEAST_TABLE_BITS, TABLE_BITS = 16, 22
#: Bits of a class's key; tests lower them.
KEY_BITS = 64
PARITY_CELLS = 256
#: Sets larger than this have a second row of parities, as in 256 cells nearly all would differ.
LARGE_SET, WIDE_CELLS = 600, 2048
#: Prefix rows of a shingle are tested against each other before they are joined up to this many.
SMALL_BLOCK = 32
#: Bits of a table that says which keys matter later on: 16 for each of them, within bounds; it only saves work.
LEAST_MARK_BITS, MARK_BITS = 12, 27


def needed_overlap(threshold: tuple[int, int], m, n):
    """ceil(t / (1 + t) (m + n)) for t = a / b, in whole numbers; of arrays too."""
    a, b = threshold
    return (a * (m + n) + a + b - 1) // (a + b)


def prefix_length(threshold: tuple[int, int], n: int) -> int:
    a, b = threshold
    return n - (a * n + b - 1) // b + 1


def _sets(batches, k: int):
    """(ids, their shingle sets) for each slice of batches of doc_id and text."""
    table = whitespace_words()
    for batch in batches:
        offsets, data = as_bytes(batch.column(1))
        for i, j in slices(offsets):
            words = words_of(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], table)
            yield batch.column(0).slice(i, j - i), list(shingle_sets(words, k))
    released()


def class_keys(s: np.ndarray, bits: int, collided: dict[int, int] = {}) -> tuple[int, int]:  # noqa: B006
    """The key of a set and a check of it, independent 64-bit hashes.  Where two sets have one key (collided
    has it, with the check of the set that keeps it) the other's key is made of its check."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    key, check = int.from_bytes(d[:8], "little", signed=True) >> (64 - bits), int.from_bytes(d[8:], "little", signed=True)
    return (key if collided.get(key, check) == check else check), check


def parities(s: np.ndarray, cells: int = PARITY_CELLS) -> bytes:
    """For each cell of hashes one bit: whether an odd number of the set is in it."""
    return np.packbits((np.bincount((mix(s) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def shingle_classes(docs: DataFrame, k: int) -> DataFrame:
    """row (what docs have as doc_id), n (size of the set), key and check (of the set; null where it is empty) and its parities
    in PARITY_CELLS cells (p0 to p3) and, if it is large, in WIDE_CELLS (wide)."""

    def find(batches):
        for ids, sets in _sets(batches, k):
            keys = [class_keys(s, KEY_BITS) if len(s) else (None, None) for s in sets]
            parity = np.frombuffer(b"".join(map(parities, sets)), "<i8").reshape(-1, 4)
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64())]
            wide = pa.array([parities(s, WIDE_CELLS) if len(s) > LARGE_SET else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, *cols, *(pa.array(np.ascontiguousarray(parity[:, i])) for i in range(4)), wide], ["row", "n", "key", "check", "p0", "p1", "p2", "p3", "wide"])

    return docs.mapInArrow(find, "row struct<doc_id:long,text_sha:binary>, n long, key long, check long, p0 long, p1 long, p2 long, p3 long, wide binary")


def table_bits(shingles: int) -> int:
    return min(TABLE_BITS, max(LEAST_TABLE_BITS, (shingles >> 4).bit_length()))


def shingle_levels(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """How frequent the shingles of each cell of the table are in all documents, in 256 steps.

    There are two counting tasks a core, however many partitions docs has: so the tables that they pass on
    grow with the cluster and not with the corpus."""

    def count(batches):
        cells, held, n = np.zeros(1 << bits, np.int64), [], 0
        for _, sets in _sets(batches, k):
            held += [(s >> np.uint64(64 - bits)).astype(np.int32) for s in sets]
            n += sum(map(len, sets))
            if n >= 1 << 20:
                cells += np.bincount(np.concatenate(held), minlength=1 << bits)
                held, n = [], 0
        if held:
            cells += np.bincount(np.concatenate(held), minlength=1 << bits)
        yield common.blocks_of(cells, 64)

    few = docs.coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    total = common.added_blocks(few.mapInArrow(count, "block int, sums binary"), 1 << bits, 64)
    return np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)


PREFIX = ["shingle", "key", "n", "pos"]


def prefixes(docs: DataFrame, k: int, threshold: tuple[int, int], levels: np.ndarray, collided: dict[int, int]) -> DataFrame:
    """shingle, key, n (the size of its set) and pos (in the order of rarity) for the prefix of each
    class, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    bits = len(levels).bit_length() - 1

    def find(batches):
        levels, seen = shared.value, set()
        for _, sets in _sets(batches, k):
            shingle, keys, sizes, pos = [], [], [], []
            for s in sets:
                key = class_keys(s, KEY_BITS, collided)[0] if len(s) else None
                if key is None or key in seen:
                    continue
                if len(seen) < 1_000_000:  # it only saves repeats, which are dropped later on
                    seen.add(key)
                n = len(s)
                p = prefix_length(threshold, n)
                rank = (levels[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                # the p least by rank, then by the shingle itself
                limit = np.partition(rank, p - 1)[p - 1]
                order = np.flatnonzero(rank <= limit)
                order = order[np.lexsort((s[order], rank[order]))][:p]
                shingle.append(s[order].view(np.int64))
                keys.append(np.full(p, key, np.int64))
                sizes.append(np.full(p, n, np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (shingle, keys, sizes, pos)], PREFIX)

    return docs.mapInArrow(find, "shingle long, key long, n int, pos int")


def may_pass(threshold: tuple[int, int], n: np.ndarray, pos: np.ndarray, m: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The filters of length and position for pairs of prefix rows."""
    t, b = threshold
    overlap = needed_overlap(threshold, n.astype(np.int64), m.astype(np.int64))
    return (b * np.minimum(n, m).astype(np.int64) >= t * np.maximum(n, m).astype(np.int64)) & (pos <= n - overlap) & (other <= m - overlap)


def shared_prefixes(rows: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The prefix rows, each once, that some other class with the same shingle can be similar to, by
    length and position.

    Rows come sorted by shingle and class.  A task holds the rows of one shingle up to SMALL_BLOCK of
    them; where there are more, all of them go on and are left to the join."""

    def keep(batches):
        empty = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
        carry, flooded, last = empty, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns]
            shingle, key = cols[:2]
            new = np.concatenate(([last != (int(shingle[0]), int(key[0]))], (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1])))
            last = (int(shingle[-1]), int(key[-1]))
            cols = [np.concatenate((a, c[new])) for a, c in zip(carry, cols)]
            if not len(cols[0]):
                continue
            tail = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            whole = [c[:tail] for c in cols]
            carry = [c[tail:] for c in cols]
            good = chosen(whole) | (whole[0] == flooded if flooded is not None else False)
            if len(carry[0]) > SMALL_BLOCK or flooded == int(carry[0][0]):
                flooded = int(carry[0][0])
                good = np.concatenate((good, np.ones(len(carry[0]), bool)))
                whole, carry = cols, empty
            yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in whole], PREFIX)
        if len(carry[0]):
            good = chosen(carry)
            yield pa.RecordBatch.from_arrays([pa.array(c[good]) for c in carry], PREFIX)

    def chosen(cols) -> np.ndarray:
        shingle, _, n, pos = cols
        good = np.zeros(len(shingle), bool)
        left = np.arange(len(shingle))
        for d in range(1, SMALL_BLOCK + 2):
            left = left[left + d < len(shingle)]
            left = left[shingle[left] == shingle[left + d]]
            if not len(left):
                break
            if d > SMALL_BLOCK:
                # a larger block: all of it goes on
                good |= np.isin(shingle, shingle[left])
                break
            fits = left[may_pass(threshold, n[left], pos[left], n[left + d], pos[left + d])]
            good[fits] = good[fits + d] = True
        return good

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(width, "shingle").sortWithinPartitions("shingle", "key")
    return placed.mapInArrow(keep, rows.schema)


def refined(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) that also pass the suffix filter on the wide parities, where both have them."""

    def keep(batches):
        for batch in batches:
            good = []
            for m, n, x, y in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                differ = int(np.bitwise_count(np.frombuffer(x, np.uint8) ^ np.frombuffer(y, np.uint8)).sum()) if x and y else 0
                good.append(differ <= m + n - 2 * needed_overlap(threshold, m, n))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c, n, w: classes.select(F.col("key").alias(c), F.col("n").alias(n), F.col("wide").alias(w))
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b")
    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(keep, "a long, b long")


def _pass(threshold: tuple[int, int]):
    """The filters on a pair of prefix rows a and b: length, position, suffix."""
    t, b = threshold
    overlap = f"(({t} * (x.n + y.n) + {t + b - 1}) div {t + b})"
    differ = " + ".join(f"bit_count(x.p{i} ^ y.p{i})" for i in range(4))
    return F.expr(
        f"{b} * least(x.n, y.n) >= {t} * greatest(x.n, y.n)"
        # the first common shingle of a similar pair leaves enough behind it in both sets
        f" and x.pos <= x.n - {overlap} and y.pos <= y.n - {overlap}"
        f" and {differ} <= x.n + y.n - 2 * {overlap}"
    )


def mark_bits(n: int) -> int:
    return min(MARK_BITS, max(LEAST_MARK_BITS, (16 * n).bit_length()))


def marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the table has the mark of each key; it has those of all keys that were marked, and of others."""
    bits = (8 * marks.nbytes).bit_length() - 1
    at = (mix(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    return (marks.view(np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def mark_table(keys: DataFrame, bits: int) -> np.ndarray:
    """A table of 2 ** bits marks, packed, set for every key in the one column of keys."""

    def mark(batches):
        marks = np.zeros(1 << bits, bool)
        for batch in batches:
            marks[(mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)] = True
        yield common.blocks_of(np.packbits(marks).view("<i8"), 64)

    few = keys.coalesce(2 * keys.sparkSession.sparkContext.defaultParallelism)
    return common.added_blocks(few.mapInArrow(mark, "block int, sums binary"), (1 << bits) // 64, 64, either=True)


def verified(docs: DataFrame, pairs: DataFrame, k: int, threshold: tuple[int, int], collided: dict[int, int]) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, written.  The sets are hashed again from the
    texts, for classes in pairs alone, and meet the pairs in two joins."""
    ends = pairs.select(F.explode(F.array("a", "b")))
    shared = docs.sparkSession.sparkContext.broadcast(mark_table(ends, mark_bits(2 * pairs.count())))
    t, base = threshold

    def find(batches):
        marks, seen = shared.value, set()
        for _, sets in _sets(batches, k):
            sets = [s for s in sets if len(s)]
            keys = np.array([class_keys(s, KEY_BITS, collided)[0] for s in sets], np.int64)
            found, raws = [], []
            for i in np.flatnonzero(marked(marks, keys)):
                key = int(keys[i])
                if key not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    found.append(key)
                    raws.append(sets[i].tobytes())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(raws, pa.binary())], ["key", "shingles"])

    sets = docs.mapInArrow(find, "key long, shingles binary")
    # a class may come from several tasks: the smallest is as good as any, all are equal
    sets = common.staged(sets.groupBy("key").agg(F.min("shingles").alias("shingles")), "sets")

    def verify(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(base * both >= t * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    links = common.staged(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "links")
    common.dropped(sets)
    return links


def similar_groups(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """For every document: doc_id, n_shingles (distinct k-word shingles; a shorter text is one) and
    component_id (the smallest doc_id that links lead to, its own included).  The threshold is a
    fraction, (4, 5) for 0.8.

    Words are runs of characters other than space and tab to carriage return, A to Z in lower case.
    Null texts and texts without words have no shingles and are linked with nothing.  Rows that repeat
    a document are linked with it.  A null id is never a component_id: a group without any other has
    null.  Empty tables give no row; columns other than doc_id and text are ignored."""
    return _groups(common.documents(docs), k, threshold).select("doc_id", "n_shingles", "component_id")


def _groups(docs: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """similar_groups with the columns root, the same for all rows of a group (null without shingles),
    and text_sha: rows that share an id are told apart by their text."""
    row = F.struct("doc_id", text_sha(F.col("text")).alias("text_sha"))
    found = common.staged(shingle_classes(docs.select(row.alias("doc_id"), "text"), k).select("row.*", "n", "key", "check", "p0", "p1", "p2", "p3", "wide"), "classes")
    found, collided = _told_apart(found)
    sketch = [F.min(c).alias(c) for c in ("n", "p0", "p1", "p2", "p3", "wide")]
    classes = common.staged(found.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least_id"), *sketch), "class-ids")
    total = found.agg(F.sum("n")).first()[0] or 0
    levels = shingle_levels(docs, k, table_bits(total))
    shared = common.staged(shared_prefixes(prefixes(docs, k, threshold, levels, collided), threshold), "prefixes")
    rows = common.staged(shared.join(classes.select("key", "p0", "p1", "p2", "p3"), "key"), "prefixes")
    common.dropped(shared)

    # First each class meets one other of each of its shingles: that with the earliest position.
    hub = rows.groupBy("shingle").agg(F.min(F.struct("pos", "n", "key", "p0", "p1", "p2", "p3")).alias("h"))
    met = rows.alias("x").join(hub.select("shingle", "h.*").alias("y"), "shingle").where(F.col("x.key") != F.col("y.key")).where(_pass(threshold))
    pairs = met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    pairs = common.staged(refined(pairs, classes, threshold), "pairs")
    links = verified(docs, pairs, k, threshold, collided)
    group = components(links)

    # Then all pairs of different groups, at shingles that two groups have.  With its first few shared
    # shingles each row tells whether a pair has met before; such rows add nothing.
    early = rows.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "shingle"))), 1, 8).alias("early"))
    grouped = rows.join(group.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    before = F.expr("transform(filter(early, e -> e.pos < pos), e -> e.shingle)")
    grouped = common.staged(grouped.join(early, "key").withColumn("before", before).drop("early"), "prefixes")
    several = grouped.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("shingle")
    left = common.staged(grouped.join(several, "shingle", "left_semi"), "prefixes")
    common.dropped(rows, grouped)
    met = left.alias("x").join(left.alias("y"), "shingle").where("x.key < y.key and x.root <> y.root").where(_pass(threshold)).where("not arrays_overlap(x.before, y.before)")
    more = met.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = common.staged(refined(more, classes, threshold), "pairs")
    common.dropped(left, pairs)
    new = verified(docs, more, k, threshold, collided)
    roots = components(links.unionByName(new)).select(F.col("node").alias("key"), "root")
    common.dropped(more, links, new)
    placed = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = common.staged(placed.join(least, "root").select("key", "root", "component_id"), "components")
    common.dropped(classes)
    out = found.join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "root", "text_sha")


#: Keys that may belong to two sets each, before something must be wrong with the hashes.
MOST_COLLIDED = 100_000


def _told_apart(found: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """found with keys that no two sets share, and the keys that had to be told apart with the check of the
    set that keeps each.  Of 10 ** 11 sets some hundreds of keys are expected to be shared."""
    checks = found.where("key is not null").groupBy("key").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    shared = checks.where("low <> high").select("key", "low").limit(MOST_COLLIDED + 1).collect()
    if len(shared) > MOST_COLLIDED:
        raise ValueError("too many different shingle sets have the same key")
    if not shared:
        return found, {}
    low = F.broadcast(found.sparkSession.createDataFrame([(r.key, r.low) for r in shared], "key long, low long"))
    apart = found.join(low, "key", "left").withColumn("key", F.when(F.coalesce(F.col("low") != F.col("check"), F.lit(False)), F.col("check")).otherwise(F.col("key"))).drop("low")
    return apart, {r.key: r.low for r in shared}


def text_sha(text):
    """The digest that tells texts apart; a null text isn't an empty one."""
    return F.unhex(F.sha2(F.coalesce(F.concat(F.lit("t"), text), F.lit("")), 256))


def one_of_each_group(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """The documents, all columns as they are, without those that are in a group with a smaller id.

    Every row is judged by its own text, whatever other rows share its id.  Rows without an id stay.  Of
    rows that share an id and a group, or an id and the whole text, the one with the smallest text stays (of
    equal texts that with the smallest other columns).  Null and empty texts are in no group.  Texts of any
    length are judged whole.  Empty tables give no row.  Columns may have any name and type.

    Verdicts are about few rows: a table of marks of bounded size tells which rows can have one, and only
    these meet the verdicts in a join.  All others go on from where they are read, so the texts aren't shuffled;
    if there are so many verdicts that all marks are set, all rows meet them, with the same result."""
    found = common.staged(_groups(common.documents(docs), k, threshold), "groups")
    ids = [F.col("doc_id").alias("id"), F.col("text_sha").alias("sha")]
    gone = found.where("doc_id <> component_id").select(*ids, F.lit(None).cast("string").alias("group")).distinct()
    first = found.where("doc_id = component_id").select(*ids, F.coalesce(F.col("root").cast("string"), F.hex("text_sha")).alias("group"))
    repeated = first.groupBy("id", "group").agg(F.count("*").alias("n")).where("n > 1").select("id", "group")
    several = first.join(repeated, ["id", "group"], "left_semi").distinct()
    verdicts = common.staged(gone.unionByName(several), "verdicts")
    common.dropped(found)
    n = verdicts.count()
    if not n:
        return docs
    mark = F.xxhash64("id", "sha")
    marks = docs.sparkSession.sparkContext.broadcast(mark_table(verdicts.select(mark), mark_bits(n)))

    @F.pandas_udf("boolean")
    def may_have(keys: pd.Series) -> pd.Series:
        return pd.Series(marked(marks.value, keys.to_numpy()))

    # the columns of docs are one struct, so no name of theirs can clash
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), text_sha(F.col("text").cast("string")).alias("sha"))
    packed = packed.withColumn("may", may_have(mark))
    judged = packed.where("may").join(verdicts.withColumn("has", F.lit(True)), ["id", "sha"], "left")
    kept = packed.where("not may").select("row").unionByName(judged.where("has is null").select("row"))
    if verdicts.where("group is not null").limit(1).count():
        rest = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        smallest = F.struct(F.col("row.text"), F.to_json(F.struct(*rest)) if rest else F.lit(0))
        once = judged.where("group is not null").groupBy("id", "group").agg(F.min_by("row", smallest).alias("row"))
        kept = kept.unionByName(once.select("row"))
    return kept.select("row.*")
