import re
import textwrap

import pytest

from marginalia.llm import licences as lc


def wrapped(text, width):
    """Paragraphs filled anew; a line with its own "Copyright (c)" stays as it is."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        held = []
        for line in [*paragraph.split("\n"), None]:
            if line is not None and not re.match(r"\s*Copyright (\(C\)|\[)", line):
                held.append(line)
                continue
            if held:
                out.append(textwrap.fill(" ".join(held), width, break_long_words=False, break_on_hyphens=False))
            held = []
            if line is not None:
                out.append(line)
        out.append("")
    return "\n".join(out)


def test_whole_licence_files_at_any_width(spark, frame):
    known = [tuple(r) for r in lc.whole_texts(spark).collect()]
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "WTFPL", "Zlib", "0BSD", "BSL-1.0"} <= {n for n, _ in known}
    heads = ["", "Copyright (c) 2020 Ann\nCopyright 2021-2022, Ben\n\n", "The MIT License (MIT)\n\n© 2020 Ann. All rights reserved.\n\n", "/*\n * Copyright Joyent, Inc. and other contributors.\n * All rights reserved.\n */\n"]
    docs, want = [], {}
    for name, text in known:
        for i, width in enumerate((24, 40, 57, 72, 79, 120, 100_000)):
            want[len(docs)] = name
            docs.append((len(docs), heads[i % 4] + wrapped(text, width)))
    got = {r.doc_id: r.licence for r in lc.licences(frame(docs)).collect()}
    assert {i: (got[i], n) for i, n in want.items() if got[i] != n} == {}


@pytest.mark.parametrize("line", ["Copyright notice and this permission", "copyright holders be liable", "(c) You must retain", "COPYRIGHT LAW. The rest", "the copyright 2020 Ann"])
def test_lines_of_the_terms_stay(line):
    assert not re.search(lc.OWNED_LINE, line.lower())


def test_more_or_less_than_a_licence_is_none(spark, frame):
    mit = next(r.text for r in lc.whole_texts(spark).collect() if r.licence == "MIT")
    docs = [(1, mit + "\nOnly on Sundays."), (2, mit.replace("The above copyright notice", "The above notice")), (3, "MIT License"), (4, mit)]
    assert {r.doc_id: r.licence for r in lc.licences(frame(docs)).collect()} == {1: None, 2: None, 3: None, 4: "MIT"}
