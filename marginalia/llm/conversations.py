"""Repairing the structure of conversations: roles (s?(ua)+)? by the least edits (see repair.py).

Turns are sorted over a range partitioning by conversation and turn, so a conversation of any length is spread over
many tasks.  What lies wholly inside a task's range, nearly all, is repaired there as it streams by, a conversation at a time.
The conversations at the ends of a range, and those beyond a bound of turns or bytes, are written as blocks of
bounded size.  For a block the least costs from each grammar state to each are sixteen numbers; these are joined from the end of
a conversation to its start, the blocks are traced in parallel for every state that they may be entered in, and the states are
joined from the start to the end.  Earlier copies of a turn are found by a grouping of digests.  Only the audit and the
running digest of a conversation are put together in one place, from pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import repair as r

SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_OPEN = "part int, block int, at int, turn long, role string, text string"
_SIZES = "turns long, blank long, duplicate long, truncated long, illegal long"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage that depends on crc32 of `conv_id:turn` modulo 20 alone: 0 drops
    a turn, 1 empties its text, 2 takes the full stops, question and exclamation marks out of it, 3 repeats it, 4 makes it
    the user's.  A null is one space, in the key too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    kept = rows.where(kind != 0).withColumns({"role": F.when(kind == 4, "user").otherwise(space("role")), "text": text, "_copies": F.when(kind == 3, 2).otherwise(1)})
    return kept.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).drop("_copy")


def _summary(turns: list, roles: list[str], texts: list[str]) -> tuple[tuple, list[tuple[str, str, str]]]:
    """The row of a whole conversation but its id, and what is left of it."""
    faults = r.faults_of(roles, texts)
    codes = bytes(r.code_of(role, r.CODE[f]) for role, f in zip(roles, faults))
    words, total = r.words_after(codes)
    done, _ = r.audit_of(codes, words, r.START)
    left, _ = r.turns_of(done, roles, texts)
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in left).encode("utf-8", "surrogatepass")).hexdigest()
    cost = total + r.layer_of(words[0], r.START)
    return (r.gaps_of(turns), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), r.illegal_pairs(role[:1] for role in roles), cost, "".join(done), digest), left


def _columns(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [()] * len(fields), fields)], [n for n, _ in fields])


def _sorted(rows: DataFrame, parts: int | None) -> DataFrame:
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    # turns that are the same in all of these are one another's copies, so that a number may deal them out
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), F.md5("text")]
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_n", F.monotonically_increasing_id())
    return rows.repartitionByRange(n, *order, "_n").sortWithinPartitions(*order).drop("_n")


def _first_pass(rows: DataFrame, most_turns: int, most_bytes: int, parts: int | None, turns_out: bool) -> DataFrame:
    """Rows of three kinds: summaries (or turns) of conversations that one task has whole, and turns of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        own, held, spread, first = None, [], True, True
        size = block = at = 0
        bytes_out = 0

        def opened(row):
            nonlocal at, block, size, bytes_out
            if at and (at % most_turns == 0 or size > most_bytes):
                block, size = block + 1, 0
            out.append((row[0], *[None] * 8, part, block, at, *row[1:]))
            at, size, bytes_out = at + 1, size + len(row[3]), bytes_out + len(row[3])

        def close():
            nonlocal held, bytes_out
            if held:
                summary, left = _summary(*map(list, zip(*(x[1:] for x in held))))
                if turns_out:
                    out.extend((held[0][0], *[None] * 8, None, None, i, None, role, text) for i, (_, role, text) in enumerate(left))
                else:
                    out.append((held[0][0], *summary, *[None] * 6))
                bytes_out += sum(len(x[3]) for x in held)
            held = []

        started = False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or row[0] != own:
                    first, started = not started, True
                    close()
                    own, spread, weight = row[0], first, 0
                if spread:
                    opened(row)
                else:
                    held.append(row)
                    weight += len(row[3])
                    if len(held) >= most_turns or weight > most_bytes:
                        for x in held:
                            opened(x)
                        held, spread = [], True
                if len(out) >= 4096 or bytes_out > 8 << 20:
                    yield _columns(out, f"{SUMMARY}, {_OPEN}")
                    out, bytes_out = [], 0
        for x in held:
            opened(x)
        yield _columns(out, f"{SUMMARY}, {_OPEN}")

    return common.staged(_sorted(rows, parts).mapInArrow(run, f"{SUMMARY}, {_OPEN}"), "conversations")


def _blocks(turns: DataFrame) -> DataFrame:
    """conv_id, part, block, its counts and ends, codes, and its sixteen costs."""
    key = ["part", "block", "conv_id"]
    same = ["conv_id", "role", F.md5("text").alias("_digest"), F.length("text").alias("_length")]
    first = turns.select(*same, F.struct("part", "at", "block").alias("_place")).groupBy("conv_id", "role", "_digest", "_length").agg(F.min("_place").alias("_place"))
    first = first.select("conv_id", "_place.part", "_place.block", "_place.at")
    shown = F.rtrim(F.col("text"), F.lit(r.SPACE))
    # numbers of turns as text: pandas has no null long
    light = turns.select(*key, "at", F.col("turn").cast("string").alias("turn"), F.col("role").substr(1, 1).alias("role"), F.when(shown == "", 2).when(F.substring(shown, -1, 1).isin(".", "!", "?"), 0).otherwise(1).cast("int").alias("cut"))
    schema = f"part int, block int, conv_id long, {_SIZES}, first_turn string, last_turn string, first_role string, last_role string, codes binary, costs array<long>"

    def one(rows: pd.DataFrame, firsts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        is_first = rows["at"].isin(set(firsts["at"])).to_numpy()
        roles, cut = rows["role"].tolist(), rows["cut"].tolist()
        faults = ["blank" if c == 2 else "duplicate" if not f else "truncated" if c else "" for c, f in zip(cut, is_first)]
        codes = bytes(r.code_of(role, r.CODE[f]) for role, f in zip(roles, faults))
        known = [int(t) for t in rows["turn"] if t is not None]
        ends = [str(known[0]), str(known[-1])] if known else [None, None]
        found = [*rows[["part", "block", "conv_id"]].iloc[0].tolist(), len(set(known)), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), r.illegal_pairs(roles), *ends, roles[0], roles[-1], codes, [-1 if c is None else c for c in r.matrix(codes)]]
        return pd.DataFrame([found], columns=[f.strip().split(" ")[0] for f in schema.split(",")]).astype({"conv_id": "object"})

    return common.staged(_together(light, first, key, one, schema), "blocks")


def _same(a: str, b: str, *more: str) -> Column:
    found = F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    for c in more:
        found = found & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return found


def _together(left: DataFrame, right: DataFrame, key: list[str], function, schema: str) -> DataFrame:
    """Both tables' rows of one block in one call.  Null ids are a group of their own, told from all others by
    a flag, since pandas has no null long."""
    flag = F.col("conv_id").isNull().alias("_none")
    plain = lambda df: df.withColumn("_none", flag).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)))

    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame(columns=[f.strip().split(" ")[0] for f in schema.split(",")])
        none = bool(a["_none"].iloc[0])
        out = function(a, b)
        if none and "conv_id" in out:
            out["conv_id"] = None
        return out

    return plain(left).groupBy(*key, "_none").cogroup(plain(right).groupBy(*key, "_none")).applyInPandas(one, schema)


def _per_conversation(df: DataFrame, function, schema: str) -> DataFrame:
    """One call for the blocks of a conversation: a few numbers for each."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        none = bool(rows["_none"].iloc[0])
        out = function(rows.sort_values(["part", "block"]))
        if none:
            out["conv_id"] = None
        return out

    return df.withColumn("_none", F.col("conv_id").isNull()).withColumn("conv_id", F.coalesce("conv_id", F.lit(0))).groupBy("conv_id", "_none").applyInPandas(one, schema)


def _ways(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The summaries of conversations but audit and digest, and the state in which every block is entered with the costs after it."""

    def backward(rows: pd.DataFrame) -> pd.DataFrame:
        after = [r.layer_of(r.ACCEPTED, s) for s in range(4)]
        out = []
        for row in reversed(list(rows.itertuples())):
            out.append((row.part, row.block, row.conv_id, [-1 if c is None else c for c in after], not out))
            after = r.joined([None if c < 0 else c for c in row.costs], after)
        return pd.DataFrame([(*o, after[r.START]) for o in reversed(out)], columns=["part", "block", "conv_id", "after", "last", "cost"])

    after = _per_conversation(blocks.select("part", "block", "conv_id", "costs"), backward, "part int, block int, conv_id long, after array<long>, last boolean, cost long")
    after = common.staged(after, "costs")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for codes, costs in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                words, _ = r.words_after(codes, r.word_of([None if c < 0 else c for c in costs])[0])
                ends.append([r.audit_of(codes, words, s, last=False)[1] if r.layer_of(words[0], s) is not None else -1 for s in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends, pa.list_(pa.int32()))], ["part", "block", "conv_id", "ends"])

    both = blocks.alias("b").join(after.alias("a"), _same("b", "a", "part", "block")).select("b.part", "b.block", "b.conv_id", "b.codes", "a.after", "a.last")
    ends = both.drop("last").mapInArrow(trace, "part int, block int, conv_id long, ends array<int>")

    def forward(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = r.START, []
        for row in rows.itertuples():
            out.append((row.part, row.block, row.conv_id, state))
            state = row.ends[state]
        return pd.DataFrame(out, columns=["part", "block", "conv_id", "entered"])

    entered = common.staged(_per_conversation(ends, forward, "part int, block int, conv_id long, entered int"), "entered")

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        sums = [int(rows[c].sum()) for c in ("turns", "blank", "duplicate", "truncated", "illegal")]
        least = last = role = None
        for row in rows.itertuples():
            if row.turns:
                # a turn that goes on over the end of a block counts once
                sums[0] -= row.first_turn == last
                least, last = least or row.first_turn, row.last_turn
            if role is not None and role + row.first_role not in ("su", "ua", "au"):
                sums[4] += 1
            role = row.last_role
        gaps = int(last) - int(least) + 1 - sums[0] if sums[0] else 0
        return pd.DataFrame([(rows["conv_id"].iloc[0], gaps, *sums[1:])], columns=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal"])

    totals = _per_conversation(blocks.drop("codes", "costs"), total, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long")
    cost = after.where("last").select(F.col("conv_id").alias("_id"), "cost")
    summaries = totals.join(cost, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    ways = both.alias("w").join(entered.alias("e"), _same("w", "e", "part", "block")).select("w.*", "e.entered")
    return summaries, ways


def _pieces(turns: DataFrame, ways: DataFrame) -> DataFrame:
    """conv_id, part, block, edits and the turns that are left (two arrays), of every block."""
    schema = "conv_id long, part int, block int, edits string, roles array<string>, texts array<string>"

    def one(rows: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        rows, way = rows.sort_values("at"), way.iloc[0]
        words, _ = r.words_after(way["codes"], r.word_of([None if c < 0 else c for c in way["after"]])[0])
        done, _ = r.audit_of(way["codes"], words, int(way["entered"]), last=bool(way["last"]))
        left, _ = r.turns_of(done, rows["role"].tolist(), rows["text"].tolist(), int(way["entered"]))
        found = (way["conv_id"], way["part"], way["block"], "".join(done), [x[1] for x in left], [x[2] for x in left])
        return pd.DataFrame([found], columns=["conv_id", "part", "block", "edits", "roles", "texts"]).astype({"conv_id": "object"})

    return common.staged(_together(turns, ways, ["part", "block", "conv_id"], one, schema), "pieces")


def _digests(pieces: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256: a digest goes over a conversation from start to end, so its pieces pass through one task,
    one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, digest, started, empty = None, None, False, True
        for batch in batches:
            ids, found = [], []
            for conv_id, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or conv_id != own:
                    if started:
                        ids.append(own)
                        found.append(digest.hexdigest())
                    own, digest, started, empty = conv_id, hashlib.sha256(), True, True
                if roles:
                    digest.update((("" if empty else "\n") + "\n".join(f"{a}:{b}" for a, b in zip(roles, texts))).encode("utf-8", "surrogatepass"))
                    empty = False
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    placed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").select("conv_id", "roles", "texts")
    return placed.mapInArrow(run, "conv_id long, repaired_sha256 string")


def conversation_repairs(rows: DataFrame, most_turns: int = 1 << 16, most_bytes: int = 16 << 20, parts: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation in rows
    (conv_id, turn, role, text).

    Turns are taken by their number, nulls first; turns of one number by role, the first 64 characters and the MD5 of the text.  A
    null role or text is one space.  Rows without conv_id are one conversation.  A turn's first fault counts: blank, a copy of an
    earlier one, or cut short.  Roles other than those of the grammar can't be kept as they are.  Repeated rows are copies;
    empty tables give no row; other columns are ignored.  Texts are read whole.  A task holds one conversation of at
    most most_turns and most_bytes, or a block of one; an audit is one value, so a conversation ends at 2^31 turns."""
    first = _first_pass(rows, most_turns, most_bytes, parts, turns_out=False)
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    whole = first.where("part is null").select(*names)
    turns = first.where("part is not null").select("conv_id", *(c.split()[0] for c in _OPEN.split(", ")))
    summaries, ways = _ways(_blocks(turns))
    pieces = _pieces(turns, ways)
    audits = pieces.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "block", "edits"))), lambda x: x.edits), "").alias("audit"))
    joined = summaries.alias("s").join(audits.alias("a"), _same("s", "a")).join(_digests(pieces).alias("d"), _same("s", "d"))
    return whole.unionByName(joined.select("s.*", "a.audit", "d.repaired_sha256").select(*names))


def repaired_turns(rows: DataFrame, most_turns: int = 1 << 16, most_bytes: int = 16 << 20, parts: int | None = None) -> DataFrame:
    """conv_id, place (ascending, from 0, with gaps between blocks), role, text: the turns of the repaired conversations.  Rows are as
    in conversation_repairs."""
    first = _first_pass(rows, most_turns, most_bytes, parts, turns_out=True)
    whole = first.where("part is null").select("conv_id", F.col("at").cast("long").alias("place"), "role", "text")
    turns = first.where("part is not null").select("conv_id", *(c.split()[0] for c in _OPEN.split(", ")))
    _, ways = _ways(_blocks(turns))
    left = _pieces(turns, ways).select("conv_id", "part", "block", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "x"))
    # ranges and their blocks ascend with the turns; an inserted turn can double a block's number of turns and one more
    place = (F.col("part").cast("long") * F.lit(1 << 20) + F.col("block")) * F.lit(4 * most_turns) + F.col("i")
    return whole.unionByName(left.select("conv_id", place.alias("place"), "x.roles", "x.texts").toDF("conv_id", "place", "role", "text"))


def with_all(conversations: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repairs of every conv_id of another table: zeros, an empty audit and the digest of nothing for those without
    turns.  Ids are grouped before they are joined."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    joined = ids.join(repairs, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero: dict[str, Column] = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    filled = joined.withColumns({**zero, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))})
    return filled.select(F.col("_id").alias("conv_id"), *(c.split()[0] for c in SUMMARY.split(", ")[1:]))
