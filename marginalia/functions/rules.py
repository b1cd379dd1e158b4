"""Decisions about records: grades, notes that aren't records, and parsed replies.  The word lists are
parameters; the defaults are this package's own except where fixed values are marked."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapsed, most_common, word_count

LABEL_CHARS = 48
DIFFER = " (scholars differ)"


@dataclass(frozen=True)
class GradeWords:
    """Words of grades.  Fixed values: they have to be those that the graded collections use."""

    sound: tuple[str, ...] = ("sahih", "hasan", "saheeh", "hassan")
    weak: tuple[str, ...] = ("daif", "da'if", "dhaeef", "weak", "munkar", "mawdu", "maudu", "fabricated", "batil", "matrook", "matruk", "shadh")
    fabricated: tuple[str, ...] = ("mawdu", "maudu", "maudoo", "fabricated", "batil", "baatil", "matrook", "matruk")

    @staticmethod
    def pattern(words: tuple[str, ...]) -> str:
        return r"(?i)(^|[^a-z0-9_])(" + "|".join(words) + r")($|[^a-z0-9_])"


def grade_texts(grades: Column) -> Column:
    """The grades that aren't blank; elements may be strings or structs with a grade."""
    return F.filter(F.transform(F.coalesce(grades, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda g: g != "")


def grade(grades: Column, words: GradeWords = GradeWords()) -> Column:
    """struct(verdict, label) of an array of grades.

    A fabrication said by anyone is weak.  Otherwise one sound grade is enough, and makes it disputed
    if another grade is weak; weak grades without a sound one make it weak; all else is ungraded.  The label
    is the commonest of the grades that decided: the sound ones, the weak ones, else all."""
    texts = grade_texts(grades)
    says = lambda kind: (lambda g: g.rlike(GradeWords.pattern(kind)))
    is_weak = says(words.weak)
    sound = F.filter(texts, lambda g: g.rlike(GradeWords.pattern(words.sound)) & ~is_weak(g))
    weak = F.filter(texts, is_weak)
    fabricated = F.exists(texts, says(words.fabricated))
    label = lambda values: F.substring(most_common(values), 1, LABEL_CHARS)
    none = F.lit(None).cast("string")
    verdict = (
        F.when(F.size(texts) == 0, "ungraded").when(fabricated, "weak")
        .when((F.size(sound) > 0) & (F.size(weak) > 0), "disputed").when(F.size(sound) > 0, "sound").when(F.size(weak) > 0, "weak").otherwise("ungraded")
    )
    shown = F.when(F.size(texts) == 0, none).when(verdict == "disputed", F.concat(label(sound), F.lit(DIFFER))).when(verdict == "sound", label(sound)).when(~fabricated & (verdict == "weak"), label(weak)).otherwise(label(texts))
    return F.struct(verdict.alias("verdict"), shown.alias("label"))


@dataclass(frozen=True)
class NoteRules:
    """What makes a record a mere note about another, over the collapsed text in lower case: too few words; an
    opening that only a note has; and a chain of names, with a verb of narration and no content of its own, that refers to
    another record or has a tail which points elsewhere, of which what stands before is short and has no sentence end.

    A collection's own openings (cross-references, remarks on how a record was passed on, narrators who pass on "the" record) are to
    be passed as patterns; the defaults are a few that need no collection."""

    least_words: int = 4
    openings: tuple[str, ...] = (
        r"^(this|that|the same|the above) (report|record|note|hadith|tradition)([^a-z]|$)",
        r"^(see|compare|as in) (above|below|record|number)",
    )
    verbs: str = r"(^|[^a-z])(narrated|reported|transmitted)([^a-z]|$)"
    content: str = r"(^|[^a-z])(said|asked|replied|commanded|forbade)([^a-z]|$)"
    refers: str = r"^[\s\S]{0,80}(similar|same) (to|as)([^a-z]|$)"
    tail: str = r"(with the same|through another|on the authority of another) chain"
    prefix_words: int = 16


def is_note(text: Column, rules: NoteRules = NoteRules()) -> Column:
    flat = F.lower(collapsed(text))
    opens = reduce(lambda a, b: a | b, (flat.rlike(p) for p in rules.openings), F.lit(False))
    place = F.regexp_instr(flat, F.lit(rules.tail))
    before = F.substring(flat, F.lit(1), F.greatest(place - 1, F.lit(0)))
    quiet = ~F.contains(F.regexp_replace(before, r"(^|[^a-z])[a-z]\.", "$1"), F.lit("."))
    tail = (place > 0) & (word_count(before) <= rules.prefix_words) & quiet
    chain = flat.rlike(rules.verbs) & ~flat.rlike(rules.content) & (flat.rlike(rules.refers) | tail)
    return (word_count(text) < rules.least_words) | opens | chain


VERDICTS = "array<struct<n:int,answers:boolean,why:string>>"


def parsed_verdicts(raw: Column, n: Column, why_chars: int = 60) -> Column:
    """array<struct<answers, why>> in the order of the candidates, from a judge's reply; null where
    nothing can be read, which is not the same as "no".

    The whole reply is read as JSON; failing that, every object in it by itself."""
    strict = F.from_json(F.regexp_extract(raw, r"(\[[\s\S]*\])", 1), VERDICTS)
    objects = F.regexp_extract_all(raw, F.lit(r"\{[^{}]*\}"), F.lit(0))
    loose = F.filter(
        F.transform(objects, lambda o: F.struct(
            F.regexp_extract(o, r'"n"\s*:\s*(\d+)', 1).try_cast("int").alias("n"),
            F.regexp_extract(o, r'"answers"\s*:\s*(true|false)', 1).try_cast("boolean").alias("answers"),
            F.regexp_extract(o, r'"why"\s*:\s*"([^"]*)"', 1).alias("why"),
        )), lambda v: v.answers.isNotNull(),
    )
    whole = F.filter(strict, lambda v: v.answers.isNotNull())
    read = F.when(F.size(F.coalesce(whole, F.array().cast(VERDICTS))) > 0, whole).otherwise(loose)

    def at(i):
        # the number that the judge gave, or its place in the list
        mine = F.filter(F.transform(read, lambda v, k: F.struct(F.coalesce(v.n, k + 1).alias("n"), v.answers.alias("answers"), v.why.alias("why"))), lambda v: v.n == i)
        v = F.get(mine, F.lit(0))
        return F.struct(v.answers.alias("answers"), F.substring(v.why, 1, why_chars).alias("why"))

    return F.when(F.size(read) > 0, F.transform(F.sequence(F.lit(1), n), at))


def parsed_questions(raw: Column) -> Column:
    """Questions of a generated reply: a JSON array, in a fence or bare; else the lines that end in a
    question mark, without bullets."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.+?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(raw)
    listed = F.from_json(F.regexp_extract(body, r"(\[[\s\S]*\])", 1), "array<string>")
    lines = F.transform(F.split(raw, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^([-*•]|\d+[.)])\s*", "")))
    asked = F.filter(lines, lambda x: x.endswith("?"))
    good = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda x: x != "")
    return F.when(F.size(good) > 0, good).otherwise(asked)


@dataclass(frozen=True)
class Topic:
    """A topic: patterns that the book's name must match, and words that make a text fit it well."""

    label: str
    books: tuple[str, ...]
    texts: tuple[str, ...] = field(default=())


#: How long what people send may be.
MOST_QUESTION, MOST_ID, MOST_SHOWN, MOST_REASON, MOST_DETAIL, MOST_VISITOR = 500, 64, 5, 64, 1000, 32


def checked_question(question: Column) -> Column:
    """struct(problem, question): the trimmed question, or why it isn't taken ("empty", "too long")."""
    text = F.trim(F.coalesce(question, F.lit("")))
    problem = F.when(text == "", "empty").when(F.length(text) > MOST_QUESTION, "too long")
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), text).alias("question"))


def guarded(rows, cut: dict[str, int], lists: dict[str, int] = {}):  # noqa: B006
    """rows with strings cut to so many characters and lists to so many elements."""
    return rows.withColumns({c: F.substring(c, 1, n) for c, n in cut.items()} | {c: F.slice(c, 1, n) for c, n in lists.items()})


def over_limit(text: Column, limit: int = 256) -> Column:
    """Whether an encoder of `limit` tokens would cut a text off; words are counted, the least it can have."""
    return word_count(text) > limit
