"""Text functions as columns."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of the word index; (?U) makes \\w mean letters and digits of any language.
WORD_TOKENS = r"(?U)\b\w\w+\b"
#: The same for ASCII text alone: what the SQL checks use, as the engines differ on other letters.
ASCII_TOKENS = r"[a-z0-9]{2,}"
#: The end of a sentence: a stop, closing marks that go with it, space, and an opening character.
SENTENCE_END = r"(?<=[.!?])[\"'”)\]]*\s+(?=[A-Z\"'“(])"


def collapsed(text: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def stripped(text: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def tokens(text: Column, pattern: str = WORD_TOKENS) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once: inside a lambda an expression runs for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def word_grams(terms: Column, low: int, high: int) -> Column:
    """n-grams of `low` to `high` consecutive terms, joined by spaces."""

    def grams(t):
        return reduce(F.concat, [F.transform(_starts(F.size(t), n), _gram(t, n)) for n in range(low, high + 1)])

    return let(terms, grams)


def _starts(size: Column, n: int) -> Column:
    """1 to size - n + 1; empty where that is less than 1."""
    return F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))


def _gram(terms: Column, n: int):
    return lambda i: F.array_join(F.slice(terms, i, n), " ")


def substrings(word: Column, n: int) -> Column:
    return F.transform(_starts(F.length(word), n), lambda i: word.substr(i, F.lit(n)))


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside words, each word with a space on both sides; a word shorter than n
    gives none of that length, and the shortest padded word is as long as the least n."""
    return F.flatten(F.transform(padded_words(text), lambda w: F.concat(*(substrings(w, n) for n in range(low, high + 1)))))


def padded_words(text: Column) -> Column:
    """The words in lower case, each with a space on both sides."""
    return F.transform(words(F.lower(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))


def sentences(text: Column) -> Column:
    """Sentences, never empty for a text that isn't blank; a blank text has none."""
    flat = collapsed(text)
    found = F.filter(F.transform(F.split(flat, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.length(flat) > 0, found).otherwise(F.array().cast("array<string>"))


def windows(parts: Column, target: int = 45, ceiling: int = 180) -> Column:
    """Windows of sentences of about `target` words that share their last sentence with the next.

    One fold over the numbers of words of the sentences, with a state of a few numbers and the bounds of the
    closed windows; the words of a window are never summed twice, and texts are cut out at the end.  A sentence
    that doesn't fit closes the window; if the window had more than one sentence, the last one opens the next,
    by itself if the new sentence doesn't fit behind it.  A window of one sentence longer than `ceiling`
    words is cut into pieces of that many."""
    bounds = "array<struct<lo:int,hi:int>>"
    start = F.struct(F.array().cast(bounds).alias("done"), F.lit(1).alias("lo"), F.lit(0).alias("n"), F.lit(0).alias("last"), F.lit(0).alias("at"))
    one = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def step(state, words):
        at = state.at + 1  # the new sentence; those before it from lo on are open
        fits = (state.at == 0) | ((state.n < target) & (state.n + words <= target))
        single = state.lo == state.at
        chained = (state.last < target) & (state.last + words <= target)
        closed = one(state.lo, state.at)
        done = F.when(fits, state.done).when(single | chained, F.concat(state.done, F.array(closed))).otherwise(F.concat(state.done, F.array(closed, one(state.at, state.at))))
        lo = F.when(fits, state.lo).when(~single & chained, state.at).otherwise(at)
        n = F.when(fits, state.n + words).when(~single & chained, state.last + words).otherwise(words)
        return F.struct(done.alias("done"), lo.alias("lo"), n.alias("n"), words.alias("last"), at.alias("at"))

    def cut(parts):
        sizes = F.transform(parts, lambda s: F.regexp_count(s, F.lit(r"(?U)\S+")))
        found = F.aggregate(sizes, start, step, lambda s: F.when(s.at > 0, F.concat(s.done, F.array(one(s.lo, s.at)))).otherwise(s.done))

        def spelled(w):
            pieces = let(words(F.element_at(parts, w.lo)), lambda long: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(long) / ceiling).cast("int") - 1, F.lit(0))), lambda i: F.array_join(F.slice(long, i * ceiling + 1, ceiling), " ")))
            long = (w.lo == w.hi) & (F.regexp_count(F.element_at(parts, w.lo), F.lit(r"(?U)\S+")) > ceiling)
            return F.when(long, pieces).otherwise(F.array(F.array_join(F.slice(parts, w.lo, w.hi - w.lo + 1), " ")))

        return F.flatten(F.transform(found, spelled))

    return let(parts, cut)


def first_match(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """(group 1 of the first anchored pattern that matches, what follows it), else (null, the text);
    both trimmed."""
    found, rest = F.lit(None).cast("string"), stripped(text)
    for p in reversed(patterns):
        hit = F.regexp_extract(text, p, 0)
        found = F.when(hit != "", stripped(F.regexp_extract(text, p, 1))).otherwise(found)
        rest = F.when(hit != "", stripped(F.substring(text, F.length(hit) + 1, F.length(text)))).otherwise(rest)
    return found, rest


def preview(text: Column, n: int = 110) -> Column:
    """The first n words, with " ..." behind them if there are more."""
    return let(words(text), lambda w: F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit(" ...")).otherwise(F.lit(""))))


def normalised(text: Column, folds: list[tuple[str, str]] = ()) -> Column:
    """Lower case, equivalent phrases folded, nothing left but a to z and single spaces.  Text beyond
    ASCII should go through `decomposed` first."""
    folded = reduce(lambda c, f: F.regexp_replace(c, f[0], f[1]), folds, F.lower(text))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[^a-z ]+", " "), " +", " "))


def decomposed():
    """A pandas UDF for Unicode's NFKD form, for which Spark has no function."""
    import unicodedata

    @F.pandas_udf("string")
    def nfkd(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))

    return nfkd


def indexed_text(narrator: Column, text: Column) -> Column:
    """What is indexed of a record: its text, after the narrator if there is one."""
    return F.when(F.length(F.coalesce(narrator, F.lit(""))) > 0, F.concat(narrator, F.lit(": "), text)).otherwise(text)


def pseudonym(salt: str, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + "|"), value), 256), 1, 24)


def day_index(day: Column, n: int) -> Column:
    """A number below n that depends on the date alone."""
    return F.conv(F.substring(F.sha2(F.date_format(day, "yyyy-MM-dd"), 256), 1, 8), 16, 10).cast("long") % n


def citation(name: Column, number: Column, book_number: Column, book_name: Column, usc: Column | None = None) -> Column:
    """"Name 5 — Book 2: Title [USC-MSA Vol 1, Book 2, No 5]", without the parts that are missing."""
    book = F.when(book_number.isNotNull(), F.concat(F.lit("Book "), book_number.cast("string"), F.when(F.length(F.coalesce(book_name, F.lit(""))) > 0, F.concat(F.lit(": "), book_name)).otherwise(F.lit(""))))
    cited = F.concat_ws(" — ", F.concat_ws(" ", name, number), book)
    if usc is None:
        return cited
    tail = F.concat(F.lit(" [USC-MSA Vol "), usc.volume.cast("string"), F.lit(", Book "), usc.book.cast("string"), F.lit(", No "), usc.number.cast("string"), F.coalesce(usc.number_suffix, F.lit("")), F.lit("]"))
    return F.when(usc.isNull(), cited).otherwise(F.concat(cited, tail))


def verification_note(verified: Column, similarity: Column, source: str) -> Column:
    return F.when(F.coalesce(verified, F.lit(False)), F.format_string(f"cross-checked against {source} (similarity %.3f)", similarity)).otherwise(F.lit("single source"))


def most_common(values: Column) -> Column:
    """The value that an array holds most often; of several the one that comes first."""

    def best(values):
        count = lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("first"), v.alias("value"))
        return F.array_max(F.transform(F.array_distinct(values), count)).value

    return let(values, best)


def vector_check(vector: Column) -> tuple[Column, Column, Column]:
    """(norm, whether it holds a component that isn't finite, whether the norm is off 1 by over 0.01)."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda a, b: a + b))
    odd = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return norm, odd, F.abs(norm - 1) > 0.01


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
