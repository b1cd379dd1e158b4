"""Whole paths, each beside its SQL: from files to a corpus, its cross-check, an index and answers, and back
to files.  The tables stand in for the entities as in the catalogue, which these queries join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import plugins
from ..functions import rules
from ..functions import text as tx
from ..operators import align, analytics, browse, expand, search
from ..shared import new_folder, staged
from ..sources import records as src
from ..sources import sinks
from . import build, retrieval
from .catalogue import (
    _CAND, _EV, _GRADES, _SUMS, _TOPIC, CHUNKS, NOTE, NOTE_SQL, _char_sql, _index_sql,
    asked_of, candidates, query, table, topics_of, usage_events,
)

# ---- corpora -----------------------------------------------------------------------------------------

#: How the editions and pages that these queries make are worded.
ATTRIBUTIONS = [r"^([a-z]+[0-9]+) writes:", r"^As told by ([^:\n]{1,80}):"]
PAGES = src.PageForm(
    between=r"~ [0-9]+ of [0-9]+ ~\s*\f\s*THE SECOND SOURCE\n*", lines=(r"^~ [0-9]+ of [0-9]+ ~$", r"^THE SECOND SOURCE$", r"^Chapter [0-9]+ -- "),
    marker=r"§([0-9]+)\.([0-9]+)\.([0-9]+)([a-z]?)\s", fields=("volume", "book", "number", "number_suffix"), narrators=(r"^([A-Z][a-z]+) tells:",),
)


def _edition_lines(spark, d) -> DataFrame:
    """Documents as editions, a line each: a book list, the document (with a narrator in front, if its source
    has a 9), and a blank record that is to be left out; one grade is an object and the other a string."""
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").join(labels, "doc_id", "left")
    text = F.when(F.contains("source", F.lit("9")), F.concat("source", F.lit(" writes: "), "text")).otherwise(F.col("text"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    first = F.when(F.col("quality") == 1, '{"grade": "Sahih"}').when(F.col("quality") == 0, '{"grade": " Daif "}')
    second = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, '"Daif"').otherwise('"Mawdu"'))
    number, book = F.col("doc_id").cast("string"), (F.col("doc_id") % 7).cast("string")
    record = F.concat(F.lit('{"hadithnumber": '), number, F.lit(', "arabicnumber": '), number, F.lit(', "text": '), quoted(text), F.lit(', "grades": ['), F.concat_ws(", ", first, second), F.lit('], "reference": {"book": '), book, F.lit(', "hadith": '), number, F.lit("}}"))
    line = F.concat(F.lit('{"metadata": {"sections": {"'), book, F.lit('": '), quoted(F.col("source")), F.lit('}}, "hadiths": ['), record, F.lit(', {"hadithnumber": 0.5, "text": " ", "grades": [], "reference": {}}]}'))
    return docs.select("lang", line.alias("value"))


def corpus_of(spark, d) -> tuple[DataFrame, DataFrame]:
    """The editions written as files, one folder a collection, read again and made one corpus."""
    folder = new_folder(spark, "editions")
    _edition_lines(spark, d).write.partitionBy("lang").text(folder)
    names = sorted(r.lang for r in table(spark, d, "documents").select("lang").distinct().collect())  # the collections
    return build.corpus([src.edition_records(src.editions(spark, f"{folder}/lang={n}", lines=True), n, ATTRIBUTIONS) for n in names])


_CORPUS = rf"""{_GRADES}, corpus as (select lang || ':' || cast(doc_id as varchar) as id, lang as collection, cast(doc_id as varchar) as hadith_number, cast(doc_id % 7 as int) as book_number, source as book_name,
  case when contains(source, '9') then source end as narrator, regexp_replace(text, '^\s+|\s+$', '', 'g') as text, verdict as grade_verdict, label as grade_label from documents join graded using (doc_id, lang))"""


@query(f"with {_CORPUS} select id, collection, hadith_number, book_number, book_name, narrator, text, grade_verdict, grade_label from corpus where grade_verdict <> 'weak'")
def edition_corpus(spark, d):
    kept, _ = corpus_of(spark, d)
    return kept.select("id", "collection", "hadith_number", "book_number", "book_name", "narrator", "text", "grade_verdict", "grade_label")


@query(f"with {_CORPUS} select collection, count(*) as n from corpus where grade_verdict = 'weak' group by collection")
def edition_weak_counts(spark, d):
    return corpus_of(spark, d)[1]


@query("""select doc_id, case when quality = 0 then 'weak' when toxic = 1 then 'sound' else 'weak' end as verdict, case when quality = 0 then 'dhaeef' when toxic = 1 then 'Hasan' else 'Weak chain' end as label from labels""")
def grade_labels(spark, d):
    """Labels of weak records are their commonest weak grade, whatever other words are commoner."""
    said = F.when(F.col("quality") == 0, F.array(F.lit("x"), F.lit("x"), F.lit("dhaeef"))).when(F.col("toxic") == 1, F.array(F.lit("x"), F.lit("x"), F.lit("Hasan"))).otherwise(F.array(F.lit("x"), F.lit("Weak chain"), F.lit("x")))
    g = rules.grade(said)
    return table(spark, d, "labels").select("doc_id", g.verdict.alias("verdict"), g.label.alias("label"))


@query("""with raw as (select item_id, text, 2 * item_id as k from benchmark) select 1 as volume, 2 as book, cast(k as int) as number, 'a' as number_suffix, 'Ann' as narrator, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from raw
  union all select 1, 2, cast(k + 1 as int), '', null, 'plain' from raw""")
def page_records_read(spark, d):
    """Records of the second source, with a page's end and head in the middle of a text."""
    number = lambda k: F.concat(F.lit("§1.2."), (2 * F.col("item_id") + k).cast("string"))
    middle = F.lit("~ 8 of 90 ~\n\n\fTHE SECOND SOURCE\n")
    raw = F.concat(number(0), F.lit("a\nAnn tells:\n"), F.substring("text", 1, 20), middle, F.expr("substring(text, 21)"), F.lit("\nChapter 3 -- of things\n"), number(1), F.lit("\nplain"))
    found = src.page_records(table(spark, d, "benchmark").select(raw.alias("text")), PAGES)
    return found.select(*(F.col(c).cast("int").alias(c) for c in ("volume", "book", "number")), "number_suffix", "narrator", "text")


@query(r"select page_id, cast(len(regexp_extract_all(html, '<a href=\"/[^\"]*\">')) as bigint) as n_1, cast(len(regexp_extract_all(html, '<p>')) as bigint) as n_2 from pages")
def marker_counts(spark, d):
    return src.marker_counts(table(spark, d, "pages").select("page_id", "html"), '<a href="/[^"]*">', "<p>", text="html").select("page_id", "n_1", "n_2")


@query("""select doc_id, case when text is null then 'missing' when trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' then 'empty' when len(string_split(text, chr(10))) < 2 then 'beyond' end as problem,
  case when len(string_split(text, chr(10))) >= 2 and trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' then array_to_string(string_split(text, chr(10))[2:3], chr(12)) end as text from documents""")
def page_range(spark, d):
    """Lines stand in for pages: the second and third of each text."""
    pages = table(spark, d, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\f")).alias("text"))
    return src.page_range(pages, 2, 3).select("doc_id", "problem", "text")


# ---- the cross-check ---------------------------------------------------------------------------------

_HALF = r"array_to_string(regexp_extract_all(text, '\S+')[1 : len(regexp_extract_all(text, '\S+')) // 2], ' ')"
_SECOND = rf"""second as (select 4 * item_id as second_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') as text from benchmark where item_id % 3 = 0 union all select 4 * item_id + 1, text || ' and six more words of its own' from benchmark where item_id % 3 = 0
    union all select 4 * item_id + 2, {_HALF} from benchmark where item_id % 3 = 1 union all select 4 * item_id + 2, array_to_string(regexp_extract_all(text, '\S+')[1:5], ' ') from benchmark where item_id % 3 = 2
    union all select 4 * item_id + 3, 'qqzq' || chr(97 + cast(item_id % 26 as int)) from benchmark)"""


def second_source(spark, d) -> DataFrame:
    """A second source made of all benchmark texts: of some a copy in capitals and a longer one, of others a half,
    of the rest a few words, and for each a text that shares nothing."""
    items = table(spark, d, "benchmark").select("item_id", "text")
    w = tx.words(F.col("text"))
    kind = F.col("item_id") % 3
    versions = [
        F.when(kind == 0, F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), F.when(kind == 0, F.concat("text", F.lit(" and six more words of its own"))),
        F.when(kind == 1, F.array_join(F.expr("slice(w, 1, size(w) div 2)"), " ")).when(kind == 2, F.array_join(F.slice("w", 1, 5), " ")),
        F.concat(F.lit("qqzq"), F.expr("char(97 + item_id % 26)")),
    ]
    rows = items.withColumn("w", w).select("item_id", F.posexplode(F.array(*versions)).alias("v", "said")).where("said is not null")
    return rows.select((4 * F.col("item_id") + F.col("v")).alias("second_id"), F.lit(None).cast("string").alias("narrator"), F.col("said").alias("text"))


def checked(spark, d) -> tuple[DataFrame, DataFrame]:
    records = table(spark, d, "benchmark").select("item_id", F.col("item_id").alias("id"), "text")
    return build.cross_checked(records, second_source(spark, d), [("of the|from the", " of ")], order="item_id")


#: A letter with a mark is the letter and, as the mark is no letter, a space.
_FLAT = lambda t: rf"trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(lower({t}), ''), lambda c: case when strip_accents(c) <> c then strip_accents(c) || ' ' else c end), ''), 'of the|from the', ' of ', 'g'), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _pair_tf(name, key, src_table):
    tok = f"regexp_extract_all({_FLAT('text')}, '[a-z]{{2,}}')"
    return f"{name} as (select {key}, term, count(*) as tf from (select {key}, unnest(list_concat(t, list_transform(range(1, greatest(len(t) - 1, 0) + 1), lambda i: t[i] || ' ' || t[i + 1]))) as term from (select {key}, {tok} as t from {src_table})) group by all)"


_CHECKED = rf"""{_SECOND}, {_index_sql("a", _pair_tf("atf", "item_id", "benchmark"), _pair_tf("aqtf", "second_id", "second"), "item_id", "second_id", "benchmark")},
  best as (select second_id, item_id, score as similarity from (select *, row_number() over (partition by second_id order by score desc, item_id) as r from ascore) where r = 1),
  every as (select second_id, coalesce(b.item_id, (select min(item_id) from benchmark)) as item_id, coalesce(similarity, 0) as similarity from second as s left join best as b using (second_id)),
  won as (select *, row_number() over (partition by item_id order by similarity desc, second_id) = 1 as first from every),
  matched as (select second_id, item_id, similarity, case when first and similarity >= 0.8 then 'verified' when not first then 'contested' when similarity >= 0.6 then 'review' else 'unmatched' end as status,
    cast(len(regexp_extract_all(s.text, '\S+')) as bigint) as left_words, cast(len(regexp_extract_all(b.text, '\S+')) as bigint) as right_words from won join second as s using (second_id) join benchmark as b using (item_id))"""


@query(f"with {_CHECKED} select second_id, item_id, similarity, status from matched")
def cross_check_status(spark, d):
    return checked(spark, d)[1].select("second_id", "item_id", "similarity", "status")


@query(f"""with {_CHECKED} select cast((select count(*) from second) as bigint) as left_total, cast((select count(*) from benchmark) as bigint) as right_total, count(*) filter (where status = 'verified') as verified,
  count(*) filter (where status = 'review') as review, count(*) filter (where status = 'contested') as contested, count(*) filter (where status = 'unmatched') as unmatched from matched""")
def cross_check_stats(spark, d):
    return align.match_stats(checked(spark, d)[1], second_source(spark, d).count(), table(spark, d, "benchmark").count())


@query(f"""with {_CHECKED}, x as (select *, case when status = 'verified' then right_words - left_words end as delta from matched) select round(quantile_cont(similarity, 0.1), 6) as p10, round(quantile_cont(similarity, 0.5), 6) as p50, round(quantile_cont(similarity, 0.9), 6) as p90,
  round(avg(delta), 6) as delta_mean, cast(median(delta) as double) as delta_median, count(*) filter (where abs(delta) > 5) as far, round(avg(cast(abs(delta) > 5 as int)), 6) as far_share from x""")
def cross_check_spread(spark, d):
    return align.similarity_spread(checked(spark, d)[1])


@query(f"with {_CHECKED} select b.item_id, m.item_id is not null as verified, round(similarity, 4) as similarity, right_words - left_words as word_delta from benchmark as b left join (select * from matched where status = 'verified') as m on b.item_id = m.item_id")
def verified_outputs(spark, d):
    """The verified corpus and its report, written and read again."""
    folder = new_folder(spark, "verified")
    records, matches = checked(spark, d)
    sinks.write_verified(records, matches, align.match_stats(matches, second_source(spark, d).count(), records.count()), folder)
    return spark.read.parquet(f"{folder}/records").select("item_id", "verified", "similarity", "word_delta")


@query(f"with {_CHECKED} select second_id, item_id, similarity from matched where status <> 'verified' order by similarity, item_id, second_id limit 10")
def cross_check_flagged(spark, d):
    return align.flagged(checked(spark, d)[1].select("second_id", "item_id", "similarity", "status")).select("second_id", "item_id", "similarity")


# ---- index and answers -------------------------------------------------------------------------------

STOP_WORDS = ["the", "of", "and", "to", "in", "is", "la", "le", "de", "der", "die", "und", "que"]
OPTIONS = retrieval.Options(notes=NOTE)
_KEPT = f"kept as (select * from documents where not {NOTE_SQL})"
_ASKED = "asked as (select conv_id as doc_id, list(text order by turn) as q from conversations where role = 'user' and text is not null and trim(text) <> '' group by conv_id)"
_NUMBERED = f"""{_KEPT}, {CHUNKS.replace("from documents", "from kept")}, {_ASKED}, numbered as (select *, row_number() over (order by kind, doc_id, ord) as no from (select doc_id, 0 as kind, ord, chunk_text from chunk
  union all select doc_id, 1, i - 1, q[i] from asked join (select distinct doc_id from kept) using (doc_id), unnest(range(1, len(q) + 1)) as t(i)))"""
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _word_tf(name, key, src_table, text):
    return rf"{name} as (select {key}, term, count(*) as tf from (select {key}, unnest(list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}'), lambda w: not list_contains({_STOPS}, w))) as term from {src_table}) group by all)"


_COUNT = lambda t: "[" + ", ".join(f"cast(length(lower({t})) - length(replace(lower({t}), '{chr(97 + i)}', '')) as double)" for i in range(26)) + "]"
_UNIT = lambda key, t, src_table: f"select {key}, list_transform(c, lambda x: x / case when n > 0 then n else 1 end) as v from (select {key}, c, sqrt(list_dot_product(c, c)) as n from (select {key}, {_COUNT(t)} as c from {src_table}))"


def _hybrid(char: bool) -> str:
    ranking = lambda p: f"""{p}full as (select item_id, doc_id, no, chunk_text, coalesce(s.score, 0) as score from benchmark cross join numbered left join {p}score as s using (item_id, no)),
  {p}best as (select * from (select *, row_number() over (partition by item_id, doc_id order by score desc, no) as part from {p}full) where part = 1),
  {p}rank as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from {p}best)"""  # noqa: E731
    words = _index_sql("w", _word_tf("wtf", "no", "numbered", "chunk_text"), _word_tf("wqtf", "item_id", "benchmark", "text"), "no", "item_id", "numbered")
    grams = _index_sql("g", _char_sql("gtf", "no", "numbered", "chunk_text"), _char_sql("gqtf", "item_id", "benchmark"), "no", "item_id", "numbered", "(1 + ln(tf))", "having count(*) >= 2 order by cf desc, term limit 300000")
    third, joined = ("+ 0.5 / (60 + g.rank)", "join grank as g using (item_id, doc_id)") if char else ("", "")
    return f"""{_NUMBERED}, {words}{", " + grams if char else ""},
  cv as materialized ({_UNIT("no", "chunk_text", "numbered")}), qv as materialized ({_UNIT("item_id", "text", "benchmark")}),
  vscore as (select item_id, no, round(list_dot_product(qv.v, cv.v), 6) as score from qv cross join cv),
  {ranking("w")}{", " + ranking("g") if char else ""}, {ranking("v")},
  hybrid as (select item_id, doc_id, v.score as vector_score, v.chunk_text, round(1.0 / (60 + w.rank) + 1.0 / (60 + v.rank) {third}, 8) as score from wrank as w join vrank as v using (item_id, doc_id) {joined}),
  answer as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from hybrid)"""


def hybrid(spark, d, options: retrieval.Options) -> DataFrame:
    encoder = plugins.letter_encoder()
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = retrieval.build(docs, "doc_id", asked_of(spark, d), encoder, options, STOP_WORDS)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return retrieval.answers(index, asked, "doc_id", encoder, options)


@query(f"with recursive {_hybrid(True)} select item_id as question_id, doc_id, rank, score, vector_score, vector_score >= 0.55 as confident, chunk_text from answer where rank <= 10")
def hybrid_answers(spark, d):
    """Notes out, texts in windows, questions beside them, three indexes, three rankings, one answer."""
    return hybrid(spark, d, OPTIONS).select("question_id", "doc_id", "rank", "score", "vector_score", "confident", "chunk_text")


@query(f"with recursive {_hybrid(False)} select item_id as question_id, doc_id, rank, score from answer where rank <= 10")
def hybrid_without_characters(spark, d):
    return hybrid(spark, d, retrieval.Options(notes=NOTE, use_characters=False)).select("question_id", "doc_id", "rank", "score")


@query(f"with recursive {_NUMBERED}, row as (select sha256(doc_id || '|' || case kind when 1 then 'q' else '' end || ord || '|' || chunk_text) as h from numbered) select sha256('model|' || cast(count(*) as varchar) || '|' || {_SUMS('h')})[1:16] as key, count(*) as n from row")
def index_name(spark, d):
    """The name of what an index would be built of: filter, windows, questions, and a digest of the chunks."""
    docs = table(spark, d, "documents").select("doc_id", "text").where(~rules.is_note(F.col("text"), NOTE))
    chunks = expand.text_chunks(docs, "doc_id").unionByName(expand.question_chunks(docs, asked_of(spark, d), "doc_id"))
    placed = chunks.withColumn("place", F.concat_ws("|", F.col("doc_id").cast("string"), "chunk_index"))
    return src.content_key(placed, "model", "chunk_text", "place")


_JUDGED = rf"""{_CAND}, read as (select item_id, doc_id, rank, item_id % 5 = 0 as degraded, cast(len(regexp_extract_all(d.text, '\S+')) as bigint) as n_words,
    2 * len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{{2,}}')), regexp_extract_all(lower(left(trim(regexp_replace(d.text, '\s+', ' ', 'g')), 700)), '[a-z0-9]{{2,}}'))) >= len(list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]{{2,}}'))) as yes
    from cand join benchmark as b using (item_id) join documents as d using (doc_id) where rank <= 10)"""


def broken_judge(prompt: str, max_tokens: int):
    raise plugins.Unavailable("no credit")


@query(f"""with {_JUDGED} select item_id, doc_id, rank, degraded, place from (select *, row_number() over (partition by item_id order by case when degraded then 0 else n_words end, rank) as place from read where degraded or yes) where place <= 3""")
def judged_answers(spark, d):
    """A judge reads the candidates; for every fifth question it can't be asked, and what was found is shown as it is."""
    found = candidates(spark, d).join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    found = staged(found, "found")
    broken = F.col("item_id") % 5 == 0
    verdicts = plugins.judged(found.where(~broken), "item_id", "question", plugins.overlap_judge).unionByName(plugins.judged(found.where(broken), "item_id", "question", broken_judge))
    return search.shown(found, verdicts, "item_id").select("item_id", "doc_id", "rank", "degraded", "place")


@query(f"""with {_CAND}, line as (select item_id, b.text as q, rank, '[' || cast(rank as varchar) || '] ' || left(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), 700) as l from cand join benchmark as b using (item_id) join documents as d using (doc_id) where rank <= 10)
  select item_id, 'Which of the passages answer the question? Return a JSON array with n, answers and why for each.' || chr(10) || chr(10) || 'Question: ' || any_value(q) || chr(10) || chr(10) || string_agg(l, chr(10) || chr(10) order by rank) as prompt, cast(count(*) as int) as n from line group by item_id""")
def judge_prompts(spark, d):
    found = candidates(spark, d).join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    return plugins.judge_prompts(found, "item_id", "question")


@query(f"""with {_CAND}, line as (select item_id, b.text as q, rank, round(score, 2) >= 0.2 as good, d.text as t, 'doc ' || cast(doc_id as varchar) as c from cand join benchmark as b using (item_id) join documents as d using (doc_id) where rank <= 10)
  select item_id, case when count(*) filter (where good) > 0 then 'Answer from the passages alone.' || chr(10) || chr(10) || string_agg('[' || cast(rank as varchar) || '] ' || t, chr(10) order by rank) filter (where good) || chr(10) || chr(10) || 'Question: ' || any_value(q) end as prompt,
  coalesce(string_agg(c, ';' order by rank) filter (where good), '') as citations, case when count(*) filter (where good) = 0 then 'I couldn''t find a passage that answers this.' end as refusal from line group by item_id""")
def grounded_prompts(spark, d):
    """Only confident candidates reach the prompt of an answer; without any there is a refusal and no prompt."""
    found = candidates(spark, d).join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    found = found.withColumn("citation", F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).withColumn("confident", search.confident(F.round("score", 2), 0.2))
    asked = plugins.answer_prompts(found, "item_id", "question", text="text")
    return asked.withColumn("citations", F.array_join("citations", ";"))


_PROMPT = r"""'Write 6 questions that this text answers, as a JSON array of strings.' || chr(10) || chr(10) || '(' || coalesce(lang, '?') || ', ' || coalesce(source, '?') || ')' || chr(10) || left(trim(regexp_replace(text, '\s+', ' ', 'g')), 4000)"""


@query(f"select doc_id, {_PROMPT} as prompt from documents")
def question_prompts(spark, d):
    return table(spark, d, "documents").select("doc_id", plugins.question_prompt(F.col("lang"), F.col("source"), F.col("text")).alias("prompt"))


def _length(prompt: str) -> str:
    return f'["How long is it? {len(prompt)}?"]'


def _short_only(prompt: str) -> str:
    if len(prompt) > 1500:
        raise plugins.Unavailable("too long today")
    return _length(prompt)


@query(f"select doc_id, ['How long is it? ' || cast(length({_PROMPT}) as varchar) || '?'] as questions from documents")
def generated_questions(spark, d):
    """A generator that fails for long prompts, and a second run that takes up what is left."""
    docs = table(spark, d, "documents")
    prompt = plugins.question_prompt(F.col("lang"), F.col("source"), F.col("text"))
    folder = new_folder(spark, "questions")
    plugins.generated_to(folder, docs, _short_only, prompt, "doc_id")
    done = plugins.generated_to(folder, docs, _length, prompt, "doc_id")
    return done.select("doc_id", rules.parsed_questions(F.col("raw")).alias("questions"))


@query(rf"with recursive {CHUNKS} select doc_id, ord, len(regexp_extract_all(chunk_text, '\S+')) > 40 as over from chunk")
def encoder_limit(spark, d):
    chunks = expand.text_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return chunks.select("doc_id", "ord", rules.over_limit(F.col("chunk_text"), 40).alias("over"))


# ---- people ------------------------------------------------------------------------------------------


@query("""select conv_id, turn, case when trim(text) = '' then 'empty' when length(trim(text)) > 500 then 'too long' end as problem, case when trim(text) <> '' and length(trim(text)) <= 500 then trim(text) end as question from conversations""")
def question_guards(spark, d):
    c = rules.checked_question(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", c.problem.alias("problem"), c.question.alias("question"))


@query("select conv_id, turn, left(text, 500) as question, left(text, 1000) as detail, left(role, 3) as reason, string_split(text, ' ')[1:5] as shown from conversations")
def feedback_guards(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.col("text").alias("detail"), F.col("role").alias("reason"), F.split("text", " ", -1).alias("shown"))
    return rules.guarded(rows, {"question": rules.MOST_QUESTION, "detail": rules.MOST_DETAIL, "reason": 3}, {"shown": rules.MOST_SHOWN})


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey in (select doc_id from documents)")
def known_picks(spark, d):
    picks = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return analytics.known_picks(picks, table(spark, d, "documents"), "l_partkey", "doc_id")


@query("select doc_id, lang, source, text from documents where doc_id = 7")
def record_lookup(spark, d):
    return browse.looked_up(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), "doc_id", 7)


@query("select count(*) as picks, count(*) filter (where l_linenumber = 1) as first, round(count(*) filter (where l_linenumber = 1) / count(*), 6) as share from lineitem")
def right_first_time(spark, d):
    return analytics.right_first_time(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("rank")))


@query("with v as (select l_partkey as question, l_suppkey as chosen, count(*) as n from lineitem group by all) select question, string_agg(cast(chosen as varchar) || ':' || cast(n as varchar), ',' order by chosen) as votes from v group by question")
def vote_maps(spark, d):
    maps = analytics.vote_maps(table(spark, d, "lineitem").select(F.col("l_partkey").alias("question"), F.col("l_suppkey").alias("chosen")), "question", "chosen")
    spelled = F.transform(F.array_sort(F.map_entries("votes")), lambda e: F.concat_ws(":", e.key.cast("string"), e.value.cast("string")))
    return maps.select("question", F.array_join(spelled, ",").alias("votes"))


@query("""select model, count(*) as calls, count(*) filter (where turn % 4 = 3) as failures, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(400) as bigint) as tokens_out, round(sum(round(tokens_in / 1e6 * coalesce(pi, 5.0) + 400 / 1e6 * coalesce(po, 25.0), 6)), 4) as cost
  from (select role as model, turn, length(text) // 4 as tokens_in from conversations) left join (values ('user', 1.0, 5.0), ('assistant', 3.0, 15.0)) as p(model, pi, po) using (model) group by model""")
def provider_totals(spark, d):
    calls = table(spark, d, "conversations").select(F.col("role").alias("model"), F.when(F.col("turn") % 4 == 3, "no credit").alias("error"), F.expr("length(text) div 4").alias("tokens_in"), F.lit(400).cast("long").alias("tokens_out"))
    prices = spark.createDataFrame([("user", 1.0, 5.0), ("assistant", 3.0, 15.0)], "model string, price_in double, price_out double")
    return analytics.provider_totals(calls, prices)


@query(f"with recursive {_TOPIC}, {CHUNKS}, {_ASKED} select (select count(distinct topic) from topic_index) as topics, (select count(*) from documents) as records, (select count(*) from chunk) as chunks, (select coalesce(sum(len(q)), 0) from asked join documents using (doc_id))::bigint as questions")
def health(spark, d):
    """One row: topics, records, chunks and generated questions."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    one = lambda df, n, c=F.count("*"): df.agg(c.alias(n))  # noqa: E731  one row each, joined as such
    parts = [one(topics_of(spark, d), "topics", F.count_distinct("topic")), one(docs, "records"), one(expand.text_chunks(docs, "doc_id"), "chunks"), one(expand.question_chunks(docs, asked_of(spark, d), "doc_id"), "questions")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])


@query("select true as durable, count(*) filter (where event_type <> 'error') as rows, count(*) filter (where event_type = 'error') as pending, max(ts) filter (where event_type <> 'error') as last_save, cast(null as varchar) as error from events")
def storage_status(spark, d):
    rows = table(spark, d, "events")
    return sinks.storage_status(rows.where("event_type <> 'error'"), rows.where("event_type = 'error'"), "ts").select("durable", "rows", "pending", "last_save", "error")


@query("select false as healthy, count(*) as rows, cast(0 as bigint) as pending, max(ts) as last_save from events")
def storage_summary(spark, d):
    rows = table(spark, d, "events")
    return sinks.storage_summary(sinks.storage_status(rows, rows.limit(0), "ts", error="disk full"))


# ---- files -------------------------------------------------------------------------------------------

_LOG = "select event_id, cast(ts as date) as d, event_type as e from events"


@query(_LOG)
def log_roundtrip(spark, d):
    """Events appended to a log in two parts, with a blank line and a torn one after them, and read again."""
    folder = new_folder(spark, "log")
    rows = table(spark, d, "events").select("event_id", F.to_date("ts").alias("d"), F.col("event_type").alias("e"))
    sinks.append_log(rows.where("event_id % 2 = 0"), folder)
    sinks.append_log(rows.where("event_id % 2 = 1"), folder)
    spark.createDataFrame([('\n{"event_id": 1, "d": "2024-',)], "value string").write.mode("append").text(folder)
    return src.log_rows(spark, folder, "event_id long, d date, e string")


@query(f"with {_EV} select d, e, left('visitor number ' || v || ' of a long name', 32) as v, count(*) as n from ev where e is not null group by all")
def log_stream_roundtrip(spark, d):
    """Events through the stream into a log: accepted ones alone, with visitors cut."""
    from ..streaming import event_stream, log_to

    folder = new_folder(spark, "event-log")
    events = usage_events(spark, d).select("d", "e", F.concat(F.lit("visitor number "), "v", F.lit(" of a long name")).alias("v"))
    events.write.json(f"{folder}/in")
    log_to(event_stream(spark, f"{folder}/in"), f"{folder}/log", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("d date, e string, v string").json(f"{folder}/log").groupBy("d", "e", "v").agg(F.count("*").alias("n"))


@query(f"with {_EV} select d, e, v, count(*) as n from ev where e is not null group by all")
def mirror_roundtrip(spark, d):
    """Events mirrored in micro-batches; a batch that is run again replaces itself."""
    from ..streaming import event_stream, mirror_to

    folder = new_folder(spark, "mirror")
    usage_events(spark, d).select("d", "e", "v").write.json(f"{folder}/in")
    for checkpoint in ("one", "two"):  # the second run begins anew and adds nothing twice
        mirror_to(event_stream(spark, f"{folder}/in"), f"{folder}/out", f"{folder}/{checkpoint}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("d date, e string, v string").parquet(f"{folder}/out").groupBy("d", "e", "v").agg(F.count("*").alias("n"))


@query("select conv_id, arg_max(case when trim(text) = '' then null else text end, turn) as text, max(turn) as turn from conversations group by conv_id")
def any_line_wins(spark, d):
    """The last line of a key, whatever it says, errors included."""
    rows = table(spark, d, "conversations").withColumn("text", F.when(F.length(F.trim("text")) > 0, F.col("text")))
    return src.last_written(rows, "conv_id", "turn", "text", "turn")


@query("select page_id, cast(length(html) as bigint) as n from pages")
def cached_table(spark, d):
    """A table by its key: made once, and then read."""
    folder, pages = new_folder(spark, "cache"), table(spark, d, "pages")
    key = src.content_key(pages, "lengths", "html", "page_id").first().key
    src.cached(spark, folder, key, lambda: pages.select("page_id", F.length("html").cast("long").alias("n")))
    return src.cached(spark, folder, key, lambda: 1 / 0)


@query("select doc_id, quality from labels union all select event_id, cast(user_id as int) from events")
def restored_rows(spark, d):
    """An empty table is filled from its copy, another is left alone, and a copy that isn't there is no error."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    events = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("user_id").cast("int").alias("quality"))
    filled = src.restored(labels.limit(0), lambda: labels)
    alone = src.restored(events, lambda: labels)
    missing = src.restored(labels.limit(0), lambda: spark.read.parquet(f"{new_folder(spark, 'none')}/x"))
    return filled.unionByName(alone).unionByName(missing)


@query("select doc_id, text from documents")
def corpus_roundtrip(spark, d):
    folder = new_folder(spark, "corpus")
    sinks.write_corpus(table(spark, d, "documents").select("doc_id", "text"), folder, "json")
    return spark.read.schema("doc_id long, text string").json(folder)


@query("select 'questions' as name union all select 'gone'")
def checked_manifest(spark, d):
    """A manifest finds the table in which a pair of equal rows is another pair, and the one that is missing."""
    pair = lambda x: spark.createDataFrame([(x,), (x,)], "text string")
    items = table(spark, d, "benchmark").select("text")
    tables = {"records": table(spark, d, "documents"), "questions": items.unionByName(pair("a"))}
    expected = sinks.manifest(spark, "model", tables | {"gone": pair("c")})
    return sinks.check_manifest(expected, sinks.manifest(spark, "model", tables | {"questions": items.unionByName(pair("b"))})).select("name")
