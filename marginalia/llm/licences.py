"""Licences by digest.

A text is brought to a canonical form, in which copies of one licence are equal: copyright lines go,
letters become lower case, equivalent spellings become one, and all ASCII characters other than letters
and digits become single spaces.  The SHA-256 of that form is joined with the digests of known texts.
Whole documents are looked up, and so is every line, for the notices that stand in a line of their own;
the forms of lines are worked out once, and that of the text is made of them.

Whole licence files name the word "copyright" in the middle of their text, so a document is looked up in
a second form too, in which only lines that say who owns the text, and titles, go.  It doesn't depend on
how a text is wrapped.
"""

from __future__ import annotations

import re
from functools import reduce
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .textwords import as_bytes, slices

#: What a line holds that says who owns the text, in lower case.
OWNER_MARKS = ("copyright", "(c)", "©", "all rights reserved")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Spellings that licence texts are compared without, each with the one it becomes.
SPELLINGS = (
    (" licence ", " license "), (" licences ", " licenses "), (" licenced ", " licensed "), (" sub license ", " sublicense "), (" sub licence ", " sublicense "),
    (" acknowledgement ", " acknowledgment "), (" analogue ", " analog "), (" authorisation ", " authorization "), (" behaviour ", " behavior "),
    (" centre ", " center "), (" favour ", " favor "), (" fulfil ", " fulfill "), (" honour ", " honor "), (" initialise ", " initialize "),
    (" judgement ", " judgment "), (" labour ", " labor "), (" merchantibility ", " merchantability "), (" non commercial ", " noncommercial "),
    (" organisation ", " organization "), (" practise ", " practice "), (" recognise ", " recognize "), (" utilisation ", " utilization "),
    (" whilst ", " while "), (" wilful ", " willful "), (" per cent ", " percent "), (" https ", " http "),
)
#: The same where two spaces stand between words.
_DOUBLED = tuple((" " + "  ".join(a.split()) + " ", " " + "  ".join(b.split()) + " ") for a, b in SPELLINGS)


def canonical(text: Column, lines: bool = True) -> Column:
    """The canonical form as a column; lines says whether the text may have more than one line."""
    lower = F.lower(text)
    owned = lambda line: reduce(lambda a, b: a | b, (F.contains(line, F.lit(m)) for m in OWNER_MARKS))
    kept = F.array_join(F.filter(F.split(lower, "\n", -1), lambda line: ~owned(line)), "\n") if lines else F.when(owned(lower), F.lit("")).otherwise(lower)
    # two spaces between words: spellings of neighbours need one each
    plain = F.concat(F.lit(" "), F.regexp_replace(kept, SEPARATORS, "  "), F.lit(" "))
    spelt = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), _DOUBLED, plain)
    return F.trim(F.regexp_replace(spelt, " +", " "))


#: A line that says who owns the text, in lower case: a mark, and then a year, a place for one, or a
#: holder.  Licences themselves go on with the words that are excluded, at whatever width they are wrapped.
_YEAR = r"(?:[0-9]{4}|[<\[{(]?(?:year|yyyy|date)\b)"
_GO_ON = (
    r"(?:notices?|holders?|holder's|owners?|owner's|licen[cs]es?|laws?|interests?|statements?|disclaimers?|and|or|the|in|on|is|as|to|for|of|with|that|this|these|those|such|may|can|shall|will|"
    r"treat(?:y|ies)|rights?|permissions?|protections?|infringements?|claims?|ownership|materials?|resulting|like|status|terms?|doctrines?|acts?|works?|if|which|who|are|was|has|have|by law|legends?|information)"
)
#: What the GPL's appendix shows as an example, inside of sentences.
_SAMPLE = r"\s*<?year>?\s+<?name"
OWNED_LINE = (
    rf"^[\s#*/;%>|!-]*(?:(?:portions|parts)\s+(?:are\s+)?)?(?:(?:(?:copyright|copr\.?)[\s:,]*(?:\(c\)|©)(?!{_SAMPLE})|©|\(c\)\s*copyright)"
    rf"|\(c\)(?!{_SAMPLE})[\s,]*{_YEAR}|(?:copyright|copr\.)(?:[\s:,]+{_YEAR}|[\s:]+(?!{_GO_ON}(?![a-z]))[^\s,.;)]))|^[\s#*/;%>|!-]*all rights reserved[\s.!]*$"
)
#: Titles at the head of a text, in lower case.
TITLES = r"\A(?:\s*(?:the\s+)?(?:[\[(#*=\s]*)(?:mit|expat|isc|x11|zlib|zlib/libpng|0bsd|(?:new |modified |revised |simplified |original )?bsd|bsd[ -][023](?:[ -]clause)?|[23][ -]clause bsd|boost software|bsl-1\.0|bsd zero[ -]clause)(?:[ \t]+(?:[\"“]?(?:new|revised|modified|simplified|[023]-clause)[\"”]?))?[ \t]+licen[cs]e(?:[ \t]*\([^\n()]{1,40}\))?(?:[ \t]*-[ \t]*version 1\.0[^\n]*)?[\])*=:. \t]*(?:\n[ \t]*[=-]{3,}[ \t]*)?(?:\n|\Z))+"


_owned_line, _titles = re.compile(OWNED_LINE, re.ASCII), re.compile(TITLES, re.ASCII)
#: Every line that is owned holds one of these.
_OWNED_HINTS = ("copy", "copr", "(c)", "©", "all rights")
#: Texts without any of these are the same in both forms.
_DIFFER = (*OWNER_MARKS, "copr.", "license", "licence")
_plain = bytes.maketrans(*(bytes(x) for x in zip(*((c, 32) for c in range(128) if c != 10 and not chr(c).isalnum()))))
_spellings = [(a.encode(), b.encode()) for a, b in _DOUBLED]
_pairs = [(a, b) for a, b in _spellings if len(a.split()) > 1]


def spelt(form: bytes, spellings=_spellings) -> bytes:
    """Words with two spaces between them, and one at both ends, in their usual spelling."""
    for a, b in spellings:
        if a in form:
            form = form.replace(a, b)
    return form


def _words(lower: str) -> bytes:
    """The words of each line, two spaces between them; lines stay apart."""
    return b" \n ".join(b"  ".join(line.split()) for line in lower.encode().translate(_plain).split(b"\n"))


def _joined(lines) -> bytes:
    """One canonical form of canonical lines: what spells over line ends is spelt now."""
    return b" ".join(spelt(b" " + b"  ".join(w for line in lines for w in line.split()) + b" ", _pairs).split())


def text_forms(text: str) -> tuple[bytes, bytes, list[bytes]]:
    """The canonical form of a text, that without owners' lines and titles only, and those of its lines."""
    lower = text.lower()
    lines = spelt(b" " + _words(lower) + b" ").split(b"\n")
    kept = lines
    if any(m in lower for m in OWNER_MARKS):
        kept = [line if not any(m in own for m in OWNER_MARKS) else b"" for line, own in zip(lines, lower.split("\n"))]
    form = whole = _joined(kept)
    if any(m in lower for m in _DIFFER):
        own = lower.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        rest = "\n".join(line for line in own if not (any(h in line for h in _OWNED_HINTS) and _owned_line.search(line)))
        whole = _joined(spelt(b" " + _words(_titles.sub("", rest)) + b" ").split(b"\n"))
    return form, whole, [b" ".join(line.split()) for line in kept]


def whole_texts(spark: SparkSession) -> DataFrame:
    """licence and text of whole licences, verbatim, one file each.  Where the terms have an end and an
    appendix follows on how to apply them, the text without the appendix is one too; lists with numbers
    are known with plain marks as well."""
    found = []
    for path in sorted((Path(__file__).parent / "licence_files").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        found.append((path.stem, text))
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        if rest.strip():
            found += [(path.stem, terms + end), (path.stem, terms)]
        if path.stem.startswith("BSD-"):
            found.append((path.stem, re.sub(r"(?m)^(\s*)[0-9]\.", r"\1*", text)))
    return spark.createDataFrame(found, "licence string, text string")


def known_texts(spark: SparkSession) -> DataFrame:
    """licence and text of the known licences and notices: one file, a few dozen of them."""
    found, name, held = [], None, []
    for line in (Path(__file__).parent / "licence_texts.txt").read_text().split("\n"):
        if line.startswith("=== "):
            if name:
                found.append((name, "\n".join(held).strip("\n")))
            name, held = line[4:].strip(), []
        else:
            held.append(line)
    found.append((name, "\n".join(held).strip("\n")))
    return spark.createDataFrame(found, "licence string, text string")


_FORMS = "digest string, whole string, lines array<string>"


def text_digests(texts: DataFrame, lengths: frozenset[int] | None) -> DataFrame:
    """The columns of texts but `text`, and digest and whole (of both forms; null where they are empty) and
    lines (digests of the lines' forms).  With lengths only lines whose form has one of these many bytes are
    hashed: others equal no known form."""
    rest = [c for c in texts.columns if c != "text"]

    def find(batches):
        sha = lambda form: sha256(form).hexdigest() if form else None
        for batch in batches:
            column = batch.column("text")
            offsets, _ = as_bytes(column)
            for i, j in slices(offsets):
                found = []
                for text in column.slice(i, j - i).to_pylist():
                    form, whole, lines = text_forms(text) if text else (b"", b"", [])
                    digest = sha(form)
                    found.append((digest, digest if whole == form else sha(whole), [sha(x) for x in {*lines} if x and (lengths is None or len(x) in lengths)]))
                cols = [pa.array(list(c), t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in rest), *cols], [*rest, "digest", "whole", "lines"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.select(*rest, "text").mapInArrow(find, ", ".join(filter(None, (kinds, _FORMS))))


def known_digests(known: DataFrame, form: str = "digest") -> DataFrame:
    """licence and digest, one row for each digest (the first name, where texts are equal)."""
    return text_digests(known.select("licence", "text"), frozenset()).where(F.col(form).isNotNull()).groupBy(F.col(form).alias("digest")).agg(F.min("licence").alias("licence"))


#: Known forms up to this many are broadcast, and their lengths are known to the tasks.
MOST_BROADCAST = 100_000


def licences(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest (of the canonical text), licence (that the whole text is, or null) and notices
    (those that lines of it are, sorted).

    A null text, or one that is empty in canonical form, has no digest and no licence.  Repeated rows
    give a row each, rows that share an id share their notices; a row without an id gets no notices.
    Very long texts are taken whole, one at a time.  Empty tables give no row; other columns are ignored.

    Texts are read once and never shuffled; what is joined are digests, written to the shared folder.  The
    table of known digests is a file of this package or is checked to have at most MOST_BROADCAST rows, else
    it is joined without a broadcast."""
    spark = docs.sparkSession
    texts = known if known is not None else known_texts(spark)
    digests = known_digests(texts)
    wholes = known_digests(known if known is not None else texts.unionByName(whole_texts(spark)), "whole").select(F.col("digest").alias("whole"), F.col("licence").alias("_licence"))
    few = known is None or known.count() <= MOST_BROADCAST
    broadcast = F.broadcast if few else lambda df: df
    lengths = None
    if few:
        lengths = frozenset(len(f) for r in texts.select("text").distinct().collect() if r.text for f in [text_forms(r.text)[0]] if f)
    found = common.staged(text_digests(common.documents(docs), lengths), "licences")
    whole = found.join(broadcast(digests), "digest", "left").join(broadcast(wholes), "whole", "left").select("doc_id", "digest", F.coalesce("_licence", "licence").alias("licence"))
    noted = found.where("doc_id is not null").select("doc_id", F.explode("lines").alias("digest")).join(broadcast(digests), "digest")
    noted = noted.groupBy("doc_id").agg(F.array_sort(F.collect_set("licence")).alias("notices"))
    none = F.array().cast("array<string>")
    # rows without an id would meet in one task
    named = whole.where("doc_id is not null").join(noted, "doc_id", "left").select("doc_id", "digest", "licence", F.coalesce("notices", none).alias("notices"))
    return named.unionByName(whole.where("doc_id is null").select("doc_id", "digest", "licence", none.alias("notices")))
