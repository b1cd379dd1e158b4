import hashlib
import heapq
import random
import zlib

import pytest

from marginalia.llm import repair
from marginalia.llm.conversations import conversation_repairs, damaged, repaired_turns, with_all

SCHEMA = "conv_id long, turn long, role string, text string, digest string, part int, cost string"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
SPACE = " \t\n\x0b\x0c\r"


def least_edits(rows):
    """(cost, audit, repaired) of (initial, role, text, fault) by trying all edits in the order of their cost."""
    heap, found = [(0, "", 0, 0, ())], None
    while heap:
        cost, audit, i, state, left = heapq.heappop(heap)
        if found and (cost, audit) >= found[:2]:
            break
        if i == len(rows) and state in (0, 3):
            found = (cost, audit, left)
        if len(audit) > 2 * len(rows) + 2:
            continue
        if i < len(rows):
            initial, role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, left))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (state, initial) in NEXT:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state, initial], (*left, f"{role}:{text}")))
                for x in ("user", "assistant"):
                    if (state, x[0]) in NEXT:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, NEXT[state, x[0]], (*left, f"{x}:{text}")))
        for x in ("user", "assistant"):
            if (state, x[0]) in NEXT:
                heapq.heappush(heap, (cost + 5, audit + "I", i, NEXT[state, x[0]], (*left, f"{x}:")))
    return found


def hurt(rows):
    out = []
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        elif kind == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """Of whole conversations at once: {conv_id: row}."""
    out = {}
    for own in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == own), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.md5(r[3].encode()).hexdigest()))
        seen, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, _, role, text in turns:
            shown = text.strip(SPACE)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            faulty.append((role[:1], role, text, fault))
        numbers = {r[1] for r in turns if r[1] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, left = least_edits(faulty)
        out[own] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def invented(seed, conversations, turns):
    random.seed(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", "User"]
    texts = ["Yes.", "No!", "Why?", "cut short", "", " \n", "So. ", "end. ", "z" * 70 + "1.", "z" * 70 + "2."]
    out = []
    for c in range(conversations):
        for t in range(random.randint(1, turns)):
            out.append((c if c else None, random.choice([t, t, t, t, None, 2 * t]), random.choice(roles), random.choice(texts)))
    return out


def as_rows(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize(("most_turns", "parts"), [(1 << 16, 3), (2, 2), (3, 7)])
def test_equal_to_all_edits(spark, most_turns, parts):
    """Whole conversations in a task, and blocks of two or three turns, over few and many ranges."""
    rows = invented(3, 14, 7)
    df = spark.createDataFrame([(*r, "d", 1, "c") for r in rows], SCHEMA).repartition(3)
    assert as_rows(conversation_repairs(df, most_turns=most_turns, parts=parts)) == plain(rows)


def test_turns_that_are_left(spark):
    rows = invented(4, 8, 6)
    df = spark.createDataFrame([(*r, "d", 1, "c") for r in rows], SCHEMA)
    want = plain(rows)
    for most_turns in (1 << 16, 2):
        found = {}
        for conv_id, place, role, text in sorted(repaired_turns(df, most_turns=most_turns, parts=3).collect(), key=lambda x: x.place):
            found.setdefault(conv_id, []).append(f"{role}:{text}")
        assert {c: hashlib.sha256("\n".join(v).encode()).hexdigest() for c, v in found.items()} == {c: w[-1] for c, w in want.items() if set(w[6]) - {"D"}}


def test_damage_and_conversations_without_turns(spark):
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate([("user", "What is it?"), ("assistant", "It is this."), (None, None)])] + [(None, None, "user", "A. B.")]
    gone = next(c for c in range(1000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Lost."))
    df = spark.createDataFrame([(*r, "d", 1, "c") for r in rows], SCHEMA)
    assert sorted(map(repr, damaged(df).collect())) == sorted(map(repr, spark.createDataFrame(hurt(rows), "conv_id long, turn long, role string, text string").collect()))
    want = {**plain(hurt(rows)), gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    found = as_rows(with_all(df, conversation_repairs(damaged(df))))
    assert {c: found[c] for c in want} == want and len(found) == 32


def test_empty_table_and_one_long_conversation(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert with_all(none, conversation_repairs(none)).collect() == []
    turns = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)] + [(2, 0, "user", "x" * 300_000)]
    found = as_rows(conversation_repairs(spark.createDataFrame([(*r, "d", 1, "c") for r in turns], SCHEMA), most_turns=100, parts=5))
    assert found[1][5:7] == (0, "K" * 3000) and found[2][:7] == (0, 0, 0, 1, 0, 2, "D")
    whole = hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in turns[:-1]).encode()).hexdigest()
    assert found[1][7] == whole


def test_layers_of_blocks_and_of_the_whole_agree():
    random.seed(9)
    for _ in range(300):
        codes = bytes(repair.code_of(random.choice("suatx"), random.choice([0, 0, 1, 2])) for _ in range(random.randint(0, 60)))
        words, total = repair.words_after(codes)
        after = [repair.layer_of(repair.ACCEPTED, s) for s in range(4)]
        cut = random.randint(0, len(codes))
        late = repair.joined(repair.matrix(codes[cut:]), after)
        assert repair.joined(repair.matrix(codes[:cut]), late)[repair.START] == total + repair.layer_of(words[0], repair.START)
