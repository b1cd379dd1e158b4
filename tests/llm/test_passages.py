"""Passages against a plain version that knows nothing of digests, units or batches of the operator."""

import random

from marginalia.llm import passages as ps

ENDS = "\n.!?。！？"


def plain(docs, words, least):
    """id -> (spans, text) of documents in the order of their ids, one row an id."""
    cut = {}
    for i, text in docs:
        units, at = [], 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] not in ENDS:
                end += 1
            while end < len(text) and text[end] in ENDS:
                end += 1
            units.append((at, end))
            at = end
        cut[i] = units
    seen, gone = {}, {}
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    split = lambda s: low(s).split()
    for i, text in sorted(docs):
        units = cut[i]
        said = [split(text[a:b]) for a, b in units]
        every = sum(map(len, said))
        for k, own in enumerate(said):
            if not own or every < least:
                continue
            b = k
            while b < len(units) and sum(map(len, said[k : b + 1])) < least:
                b += 1
            a = k
            if b == len(units):
                b = max(x for x in range(len(units)) if said[x])
                while sum(map(len, said[a : b + 1])) < least:
                    a -= 1
            form = tuple(w for x in said[a : b + 1] for w in x)
            if seen.setdefault(form, (i, a)) != (i, a):
                gone.setdefault(i, set()).update(range(a, b + 1))
    out = {}
    for i, text in docs:
        units, spans, run = cut[i], [], []
        said = [split(text[a:b]) for a, b in units]
        for k in range(len(units) + 1):
            if k < len(units) and (k in gone.get(i, ()) or not said[k]):
                run.append(k)
                continue
            if run and sum(len(said[x]) for x in run) >= max(words, 1):
                spans.append((units[run[0]][0], units[run[-1]][1]))
            run = []
        keep = "".join(c for x, c in enumerate(text) if not any(a <= x < b for a, b in spans))
        out[i] = (spans, keep)
    return out


def test_against_the_plain_version(frame):
    rng = random.Random(3)
    word = lambda: rng.choice("tree Tree stone river hill cloud rain".split()) + rng.choice(["", "", "", ".", "!", "\n", ".\n\n", "  "])
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 25))) for _ in range(3)]
        if i % 3:
            parts.insert(1, rng.choice(passages))
        docs.append((i, " ".join(parts)))
    docs.append((200, docs[7][1]))
    for words, least in ((25, 6), (8, 4)):
        want = plain(docs, words, least)
        got = {r.doc_id: ([(s.start, s.end) for s in r.removed], r.text) for r in ps.without_passages(frame(docs), words, least).collect()}
        assert got == want and any(s for s, _ in want.values())


def test_a_passage_inside_of_lines_and_over_their_ends(frame):
    passage = " ".join(f"word{i}{'.' if i % 9 == 8 else ''}" + ("\nnext" if i == 30 else "") for i in range(56))
    got = {r.doc_id: r for r in ps.without_passages(frame([(1, f"First of all. {passage} And then."), (2, f"Other beginning here! {passage.upper()} Another end of it"), (3, "Quite another text, of one line. First of all.")])).collect()}
    assert not got[1].has_repeats and not got[3].has_repeats and got[2].has_repeats
    assert [(s.start, s.end) for s in got[2].removed] == [(21, 21 + 1 + passage.upper().rindex(".") + 1)]
    assert got[2].text == "Other beginning here!" + " WORD54 WORD55 Another end of it"


def test_scripts_without_spaces(frame):
    line = "".join(chr(0x4E00 + 7 * i) for i in range(60)) + "。"
    got = {r.doc_id: r for r in ps.without_passages(frame([(1, line), (2, "前書き。" + line)])).collect()}
    assert got[2].text == "前書き。" and got[1].text == line


def test_awkward_rows(frame, awkward):
    repeated = " ".join(f"w{i}" for i in range(40))
    docs = [*awkward, (30, repeated), (31, repeated + "\n"), (32, repeated), (32, "its neighbour differs from it, and has as many words as it needs"), (None, repeated), (31, repeated + "\n")]
    rows = ps.without_passages(frame(docs)).collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and not by[1][0].has_repeats and by[2][0].text == ""
    assert by[30][0].text == repeated and [r.text for r in by[31]] == ["", ""]
    assert sorted(r.text for r in by[32]) == ["", "its neighbour differs from it, and has as many words as it needs"]
    assert sorted(str(r.text) for r in by[None]) == sorted(map(str, [repeated, "A row without an id.", None]))
    assert not by[8][0].has_repeats and by[7][0].text == "x" * 200_000
    assert ps.without_passages(frame([])).count() == 0
