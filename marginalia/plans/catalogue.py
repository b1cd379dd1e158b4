"""The registered queries, each beside the SQL that gives the same rows.

The driver's tables stand in for the entities of a text collection: documents for records (lang for the
collection, source for the book), labels for grades, benchmark for questions, conversations for users'
questions and generated ones, pages for a second source, embeddings for chunk vectors (label for the
relevant class), events for usage events, lineitem for picks (l_orderkey the question, l_linenumber the
rank).  Every query runs over its whole tables; limits stand only where the operator is a top-k, a page
or a sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..functions.rules import Topic
from ..operators import align, analytics, browse, evaluate, expand, parts, search, topk, vectors
from ..operators import postings as ps
from ..plugins import overlap_scorer
from ..sources import records as src
from ..sources import sinks
from ..shared import few, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOK = "regexp_extract_all(lower(text), '[a-z0-9]{2,}')"


def ascii_terms(text="text"):
    return tx.tokens(F.col(text), tx.ASCII_TOKENS)


# ---- text ------------------------------------------------------------------------------------------


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as text from documents")
def ws_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.collapsed(F.col("text")).alias("text"))


@query(r"select doc_id, cast(len(regexp_extract_all(text, '\S+')) as bigint) as n_words from documents")
def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("n_words"))


@query(r"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, 'lang="([a-z]+)"', 1) as lang,
  cast(len(regexp_extract_all(html, '<p>')) as bigint) as n_paragraphs from pages""")
def page_fields(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_count(html, F.lit("<p>")).cast("long").alias("n_paragraphs"))


@query(r"""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<script>[^<]*(</p>[^<]*)?</script>|<style>[^<]*</style>|<nav>.*</nav>|<!--[^>]*-->', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as text from pages""")
def page_text_clean(spark, d):
    block = r"<script>[^<]*(</p>[^<]*)?</script>|<style>[^<]*</style>|<nav>.*</nav>|<!--[^>]*-->"
    plain = F.regexp_replace(F.regexp_replace("html", block, ""), "<[^>]*>", " ")
    return table(spark, d, "pages").select("page_id", tx.collapsed(plain).alias("text"))


@query(r"""select page_id, i - 1 as ord, regexp_extract(marks[i], 'href="/([^"]*)"', 1) as target, regexp_replace(parts[i + 1], '^\s+|\s+$', '', 'g') as body
  from (select page_id, regexp_extract_all(html, '<a href="/[^"]*">') as marks, regexp_split_to_array(html, '<a href="/[^"]*">') as parts from pages), unnest(range(1, len(marks) + 1)) as t(i)""")
def page_split(spark, d):
    rows = src.split_records(table(spark, d, "pages").select("page_id", "html"), '<a href="/([^"]*)">', ["target"], text="html")
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), "target", "body")


@query(r"""select event_id, case when event_id % 7 <> 0 then try_cast(regexp_extract(props, '"k": ([0-9]+)', 1) as bigint) end as k, event_id % 7 <> 0 as readable from events""")
def props_parse_tolerant(spark, d):
    """Every seventh line is torn: its last character is missing."""
    line = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    parsed = F.from_json(line, "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = table(spark, d, "events").select("event_id", parsed.alias("p"), F.col("props").isNotNull().alias("there"))
    readable = F.col("p._corrupt_record").isNull() & F.col("there")
    return rows.select("event_id", F.when(readable, F.col("p.k")).alias("k"), readable.alias("readable"))


@query("select conv_id, arg_max(text, turn) as text, max(turn) as turn from conversations where text is not null and trim(text) <> '' group by conv_id")
def last_write_wins(spark, d):
    return src.last_written(table(spark, d, "conversations"), "conv_id", "turn", "text", "turn", where=F.length(F.trim("text")) > 0)


@query(r"""select doc_id, case when regexp_matches(text, '^([A-Z][a-z]+), ') then regexp_extract(text, '^([A-Z][a-z]+), ', 1)
    when regexp_matches(text, '^([A-Z][a-z]+) and ') then regexp_extract(text, '^([A-Z][a-z]+) and ', 1)
    when regexp_matches(text, '^(The [a-z]+) ') then regexp_extract(text, '^(The [a-z]+) ', 1) end as head,
  regexp_replace(case when regexp_matches(text, '^([A-Z][a-z]+), ') then regexp_replace(text, '^([A-Z][a-z]+), ', '')
    when regexp_matches(text, '^([A-Z][a-z]+) and ') then regexp_replace(text, '^([A-Z][a-z]+) and ', '')
    when regexp_matches(text, '^(The [a-z]+) ') then regexp_replace(text, '^(The [a-z]+) ', '') else text end, '^\s+|\s+$', '', 'g') as rest from documents""")
def first_match_extract(spark, d):
    head, rest = tx.first_match(F.col("text"), ["^([A-Z][a-z]+), ", "^([A-Z][a-z]+) and ", "^(The [a-z]+) "])
    return table(spark, d, "documents").select("doc_id", head.alias("head"), rest.alias("rest"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'of the|from the', ' of ', 'g'), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')) as text from documents""")
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalised(F.col("text"), [("of the|from the", " of ")]).alias("text"))


SENT_SQL = r"""string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])["''”)\]]*\s+([A-Z"''“(])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


@query(f"""select doc_id, i - 1 as ord, parts[i] as sentence from (select doc_id, {SENT_SQL} as parts from documents where trim(text) <> ''), unnest(range(1, len(parts) + 1)) as t(i)""")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("ord", "sentence")).select("doc_id", F.col("ord").cast("long").alias("ord"), "sentence")


# ---- grades and notes ------------------------------------------------------------------------------

_GRADES = """graded as (select d.doc_id, d.lang, case when l.doc_id is null then 'ungraded' when quality = 0 and toxic = 1 then 'weak' when quality = 1 and toxic = 1 then 'disputed' when quality = 1 then 'sound' else 'weak' end as verdict,
  case when l.doc_id is null then null when quality = 0 and toxic = 1 then 'Daif' when quality = 1 and toxic = 1 then 'Sahih (scholars differ)' when quality = 1 then 'Sahih' else 'Daif' end as label
  from documents as d left join labels as l using (doc_id))"""


def grades_of(spark, d) -> DataFrame:
    """Labels as grades: good quality is a sound grade, bad a weak one; a toxic text has a second grader
    who calls it weak, or fabricated if it is bad as well."""
    labels = table(spark, d, "labels")
    first = F.when(F.col("quality") == 1, "Sahih").otherwise("Daif")
    second = F.when(F.col("toxic") == 1, F.when(F.col("quality") == 1, "Daif").otherwise("Mawdu"))
    labels = labels.select("doc_id", F.array_compact(F.array(first, second)).alias("grades"))
    g = rules.grade(F.col("grades"))
    return table(spark, d, "documents").join(labels, "doc_id", "left").select("doc_id", "lang", g.verdict.alias("verdict"), g.label.alias("label"))


@query(f"with {_GRADES} select doc_id, verdict, label from graded")
def grade_classify(spark, d):
    return grades_of(spark, d).select("doc_id", "verdict", "label")


@query(f"with {_GRADES} select doc_id, lang, verdict from graded where verdict <> 'weak'")
def drop_weak(spark, d):
    return grades_of(spark, d).where("verdict <> 'weak'").select("doc_id", "lang", "verdict")


@query(f"with {_GRADES} select lang, verdict, count(*) as n from graded group by all")
def verdict_counts(spark, d):
    return grades_of(spark, d).groupBy("lang", "verdict").agg(F.count("*").alias("n"))


NOTE = rules.NoteRules(openings=(r"^(the|is|and) [a-z]+ (to|of) ",), verbs=r"(^|[^a-z])(tion|onst)([^a-z]|$)", content=r"(^|[^a-z])(heen|hein)([^a-z]|$)", refers=r"^[\s\S]{0,80}(nt|or) (is|as)([^a-z]|$)", tail=r"(of|with) the ")
_FLAT = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"
_BEFORE = f"case when regexp_matches({_FLAT}, '(of|with) the ') then regexp_extract({_FLAT}, '^([\\s\\S]*?)(?:of|with) the ', 1) end"
NOTE_SQL = rf"""(len(regexp_extract_all(text, '\S+')) < 4 or regexp_matches({_FLAT}, '^(the|is|and) [a-z]+ (to|of) ') or (regexp_matches({_FLAT}, '(^|[^a-z])(tion|onst)([^a-z]|$)')
  and not regexp_matches({_FLAT}, '(^|[^a-z])(heen|hein)([^a-z]|$)') and (regexp_matches({_FLAT}, '^[\s\S]{{0,80}}(nt|or) (is|as)([^a-z]|$)')
  or coalesce(len(regexp_extract_all({_BEFORE}, '\S+')) <= 16 and not contains(regexp_replace({_BEFORE}, '(^|[^a-z])[a-z]\.', '\1', 'g'), '.'), false))))"""


@query(f"select doc_id, {NOTE_SQL} as is_note from documents")
def stub_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", rules.is_note(F.col("text"), NOTE).alias("is_note"))


@query(f"select lang, count(*) filter (where not is_note) as kept, count(*) filter (where is_note) as dropped from (select lang, {NOTE_SQL} as is_note from documents) group by lang")
def stub_partition_counts(spark, d):
    note = rules.is_note(F.col("text"), NOTE)
    return table(spark, d, "documents").select("lang", note.alias("note")).groupBy("lang").agg(F.count_if(~F.col("note")).alias("kept"), F.count_if(F.col("note")).alias("dropped"))


# ---- chunks ----------------------------------------------------------------------------------------

CHUNKS = rf"""sent as (select doc_id, i, parts[i] as s, cast(len(regexp_extract_all(parts[i], '\S+')) as bigint) as w, len(parts) as n
    from (select doc_id, {SENT_SQL} as parts from documents where trim(text) <> ''), unnest(range(1, len(parts) + 1)) as t(i)),
  cum as (select *, sum(w) over (partition by doc_id order by i) as c from sent),
  ends as (select a.doc_id, a.i as lo, a.n, greatest(a.i, least(
      coalesce((select min(b.i) from cum as b where b.doc_id = a.doc_id and b.i >= a.i and b.c - a.c + a.w >= 45), a.n),
      coalesce((select min(b.i) - 1 from cum as b where b.doc_id = a.doc_id and b.i > a.i and b.c - a.c + a.w > 45), a.n))) as hi from cum as a),
  win as (select doc_id, lo, hi, n, 0 as k from ends where lo = 1
    union all select e.doc_id, e.lo, e.hi, e.n, k + 1 from win as v join ends as e on e.doc_id = v.doc_id and e.lo = greatest(v.hi, v.lo + 1) where v.hi < v.n),
  whole as (select v.doc_id, k, string_agg(s, ' ' order by i) as t, sum(w) as w, count(*) as m from win as v join sent as s on s.doc_id = v.doc_id and i between lo and hi group by v.doc_id, k),
  cut as (select doc_id, k, j, case when m = 1 and w > 180 then array_to_string(string_split(t, ' ')[j * 180 + 1 : j * 180 + 180], ' ') else t end as chunk_text
    from whole, unnest(range(0, case when m = 1 and w > 180 then cast(ceil(w / 180.0) as bigint) else 1 end)) as u(j)),
  chunk as (select doc_id, row_number() over (partition by doc_id order by k, j) - 1 as ord, chunk_text from cut
    union all select doc_id, 0, text from documents where trim(text) = '')"""


def chunks_of(spark, d) -> DataFrame:
    return expand.text_chunks(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query(f"with recursive {CHUNKS} select doc_id, ord, chunk_text from chunk")
def chunk_windows(spark, d):
    return chunks_of(spark, d).select("doc_id", "ord", "chunk_text")


@query(rf"""with recursive {CHUNKS}, l as (select len(regexp_extract_all(chunk_text, '\S+')) as w, row_number() over (order by len(regexp_extract_all(chunk_text, '\S+'))) - 1 as p, count(*) over () as n from chunk)
  select max(n) as n, max(w) filter (where p = cast(floor(n * 0.5) as bigint)) as p50, max(w) filter (where p = cast(floor(n * 0.9) as bigint)) as p90, max(w) as most from l""")
def chunk_length_stats(spark, d):
    return expand.chunk_lengths(chunks_of(spark, d), "doc_id")


_QUESTIONS = "asked as (select conv_id as doc_id, list(text order by turn) as q from conversations where role = 'user' and text is not null and trim(text) <> '' group by conv_id)"


def asked_of(spark, d) -> DataFrame:
    """Users' turns stand in for generated questions; conversation n belongs to document n."""
    turns = table(spark, d, "conversations").where((F.col("role") == "user") & (F.length(F.trim("text")) > 0))
    grouped = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return grouped.select("doc_id", F.transform("t", lambda x: x.text).alias("questions"))


@query(f"""with recursive {CHUNKS}, {_QUESTIONS} select doc_id, cast(ord as varchar) as chunk_index, chunk_text, 'text' as chunk_type from chunk
  union all select doc_id, 'q' || cast(i - 1 as varchar), q[i], 'question' from asked join (select distinct doc_id from documents) using (doc_id), unnest(range(1, len(q) + 1)) as t(i)""")
def expansion_union(spark, d):
    docs = table(spark, d, "documents")
    both = chunks_of(spark, d).unionByName(expand.question_chunks(docs, asked_of(spark, d), "doc_id"))
    return both.select("doc_id", "chunk_index", "chunk_text", "chunk_type")


@query(f"""with {_QUESTIONS} select count(*) as records, count(q) as covered, cast(coalesce(sum(len(q)), 0) as bigint) as questions, round(count(q) / count(*), 6) as share from documents left join asked using (doc_id)""")
def coverage(spark, d):
    return expand.coverage(table(spark, d, "documents"), asked_of(spark, d), "doc_id")


# ---- scoring ---------------------------------------------------------------------------------------

_TF = f"tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOK}) as term from documents) group by all), n as (select count(*) as n from documents), df as (select term, count(*) as df, cast(sum(tf) as bigint) as cf from tf group by term), idf as (select term, df, ln((1 + n) / (1 + df)) + 1 as idf from df, n)"
_POST = f"{_TF}, raw as (select doc_id, term, tf * idf as w from tf join idf using (term)), post as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw)"
_QPOST = f"qtf as (select item_id, term, count(*) as tf from (select item_id, unnest({TOK}) as term from benchmark) group by all), qraw as (select item_id, term, tf * idf as w from qtf join idf using (term)), qpost as (select item_id, term, w / sqrt(sum(w * w) over (partition by item_id)) as weight from qraw)"
_SCORE = f"{_POST}, {_QPOST}, score as (select item_id, doc_id, round(sum(p.weight * q.weight), 6) as score from qpost as q join post as p using (term) group by all)"


def words_of(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(ascii_terms(), F.array().cast("array<string>")).alias("words"))


def _ranking(spark, d, words, grams: tuple[int, int] | None = None, **kept) -> topk.TextList:
    """Documents by the terms that they share with benchmark texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    counted = staged(topk.document_words(docs, "doc_id", words), "document-words")
    vocabulary = staged(topk.vocabulary(counted, docs.count(), grams=grams, **kept), "terms")
    asked = staged(topk.document_words(table(spark, d, "benchmark").select("item_id", "text"), "item_id", words), "asked")
    return topk.TextList(asked, counted, vocabulary, sublinear=grams is not None, grams=grams)


def by_words(spark, d) -> topk.TextList:
    return _ranking(spark, d, ascii_terms())


def by_characters(spark, d) -> topk.TextList:
    return _ranking(spark, d, tx.padded_words(F.col("text")), (3, 5), min_df=2, max_features=300_000)


@query(f"with {_TF} select term, df, cf from df")
def doc_frequency(spark, d):
    return topk.vocabulary(words_of(spark, d), 0).select("term", "df", "cf")


@query(f"with {_TF} select term, round(idf, 6) as idf from idf")
def idf_table(spark, d):
    return topk.vocabulary(words_of(spark, d), table(spark, d, "documents").count()).select("term", F.round("idf", 6).alias("idf"))


@query(f"with {_POST} select doc_id, term, round(weight, 6) as weight from post")
def tfidf_postings(spark, d):
    docs = table(spark, d, "documents")
    counted = staged(topk.document_words(docs, "doc_id", ascii_terms()), "document-words")
    vocabulary = staged(topk.vocabulary(counted, docs.count()), "terms")
    return topk.weighted(counted, vocabulary).withColumn("weight", F.round("weight", 6))


@query(f"with {_SCORE} select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score) where rank <= 3")
def tfidf_topk(spark, d):
    return by_words(spark, d).first(3)


def _char_sql(name, key, src_table, text="text"):
    return rf"""{name} as (select {key}, term, count(*) as tf from (select {key}, unnest(list_concat(
      list_transform(range(1, greatest(length(w) - 2, 0) + 1), lambda i: w[i : i + 2]), list_transform(range(1, greatest(length(w) - 3, 0) + 1), lambda i: w[i : i + 3]), list_transform(range(1, greatest(length(w) - 4, 0) + 1), lambda i: w[i : i + 4]))) as term
      from (select {key}, ' ' || unnest(regexp_extract_all(lower({text}), '\S+')) || ' ' as w from {src_table})) group by all)"""


def _index_sql(p: str, tf: str, qtf: str, key: str, qkey: str, src_table: str, weight: str = "tf", kept: str = "") -> str:
    """CTEs, all names with the prefix p, from term counts of documents and questions to scores."""
    return f"""{tf}, {p}n as (select count(*) as n from {src_table}), {p}df as (select term, count(*) as df, sum(tf) as cf from {p}tf group by term {kept}),
  {p}idf as (select term, ln((1 + n) / (1 + df)) + 1 as idf from {p}df, {p}n), {p}raw as (select {key}, term, {weight} * idf as w from {p}tf join {p}idf using (term)), {p}post as (select {key}, term, w / sqrt(sum(w * w) over (partition by {key})) as weight from {p}raw),
  {qtf}, {p}qraw as (select {qkey}, term, {weight} * idf as w from {p}qtf join {p}idf using (term)), {p}qpost as (select {qkey}, term, w / sqrt(sum(w * w) over (partition by {qkey})) as weight from {p}qraw),
  {p}score as (select {qkey}, {key}, round(sum(p.weight * q.weight), 6) as score from {p}qpost as q join {p}post as p using (term) group by all)"""


_MOST_GRAMS = "having count(*) >= 2 order by cf desc, term limit 300000"


def _char_index_sql(p: str) -> str:
    return _index_sql(p, _char_sql(f"{p}tf", "doc_id", "documents"), _char_sql(f"{p}qtf", "item_id", "benchmark"), "doc_id", "item_id", "documents", "(1 + ln(tf))", _MOST_GRAMS)


_CHAR = _char_index_sql("")


@query(f"with {_CHAR} select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score) where rank <= 3")
def char_ngram_topk(spark, d):
    return by_characters(spark, d).first(3)


_VQ = "select vec_id as query_id, embedding as q, label as query_label from embeddings where vec_id % 100 = 0"
_VSCORE = f"vs as (select query_id, query_label, vec_id, label, round(list_dot_product(cast(q as double[]), cast(embedding as double[])), 6) as score from ({_VQ}) as a join embeddings as b on query_id <> vec_id)"
_VRANK = f"{_VSCORE}, vr as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from vs)"


def vectors_of(spark, d) -> tuple[DataFrame, DataFrame]:
    """A stated set of queries, the vectors whose id is divisible by 100, and all vectors."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), rows


@query(f"with {_VRANK} select query_id, vec_id, score, rank from vr where rank <= 5")
def vector_cosine_topk(spark, d):
    return vectors.nearest(*vectors_of(spark, d), 5).select("query_id", "vec_id", "score", "rank")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 6) as norm, len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) > 0 as odd, abs(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) - 1) > 0.01 as off from embeddings")
def vector_sanity(spark, d):
    norm, odd, off = tx.vector_check(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm, 6).alias("norm"), odd.alias("odd"), off.alias("off"))


@query(f"with {_VSCORE}, g as (select query_id, vec_id // 4 as record, vec_id % 4 as part, score from vs) select query_id, record, max(score) as score, arg_max(part, score * 1000000 * 8 - part) as part from g group by all")
def best_chunk_per_doc(spark, d):
    asked, rows = vectors_of(spark, d)
    parts = rows.select("vec_id", "vector", F.expr("vec_id div 4").alias("record"), (F.col("vec_id") % 4).alias("part"))
    return vectors.best_parts(asked, parts).select("query_id", "record", "score", "part")


_RRF = f"""{_SCORE}, {_char_index_sql("c")}, pair as (select item_id, doc_id, coalesce(score, 0) as word_score from (select item_id from benchmark) cross join (select doc_id from documents) left join score using (item_id, doc_id)),
  wr as (select *, row_number() over (partition by item_id order by word_score desc, doc_id) as word_rank from pair),
  cr as (select item_id, doc_id, row_number() over (partition by item_id order by score desc, doc_id) as char_rank from cscore),
  vec as (select b.vec_id as item_id, e.vec_id as doc_id, round(list_dot_product(cast(b.embedding as double[]), cast(e.embedding as double[])), 6) as vector_score from embeddings as b join benchmark on b.vec_id = item_id cross join embeddings as e),
  vr as (select *, row_number() over (partition by item_id order by vector_score desc, doc_id) as vector_rank from vec),
  fused as (select item_id, doc_id, word_score, vector_score, round(1.0 / (60 + word_rank) + 1.0 / (60 + vector_rank) + 0.5 / (60 + coalesce(char_rank, (select count(*) from documents))), 8) as score from wr join vr using (item_id, doc_id) left join cr using (item_id, doc_id)),
  rrf as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from fused)"""


def fused_answers(spark, d, k: int = 10) -> DataFrame:
    """Word and character scores of benchmark texts fused with cosines of the vectors of the same numbers."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = staged(vectors.join(table(spark, d, "benchmark").select("item_id"), F.col("doc_id") == F.col("item_id")).select("item_id", "vector"), "asked-vectors")
    rankings = [(r, staged(topk.question_terms(r.asked, r.terms, r.sublinear, r.grams), "question-terms"), r.counted.select("doc_id", F.array("words").alias("words"))) for r in (by_words(spark, d), by_characters(spark, d))]
    n, found = table(spark, d, "documents").count(), None
    for block in ps.query_blocks(asked, "item_id", parts.MOST_QUESTIONS):
        keys = block.select("item_id")
        word, char = (parts.scored_texts(keys, own, words, r.terms, r.sublinear, r.grams) for r, own, words in rankings)
        vector = parts.scored_vectors(block, vectors.select("doc_id", F.array("vector").alias("vectors")))
        one = topk.fused_scored(word, vector, char, n, k)
        parts.removed(word.rows, vector.rows, char.rows)
        found = one if found is None else found.unionByName(one)
    return found


@query(f"with {_RRF} select item_id, doc_id, score, rank from rrf where rank <= 10")
def rrf_fusion(spark, d):
    return fused_answers(spark, d).where("rank <= 10").select("item_id", "doc_id", "score", "rank")


@query(f"with {_RRF} select item_id, doc_id, vector_score, rank from rrf where rank <= 10 and vector_score >= 0.3")
def confidence_gate(spark, d):
    return fused_answers(spark, d).where("rank <= 10").where(search.confident(F.col("vector_score"), 0.3)).select("item_id", "doc_id", "vector_score", "rank")


_CAND = f"{_SCORE}, cand as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score)"
_OVERLAP = f"round(len(list_intersect(list_distinct({TOK.replace('text', 'b.text')}), {TOK.replace('text', 'd.text')})) / greatest(len(list_distinct({TOK.replace('text', 'b.text')})), 1), 6)"


def candidates(spark, d, k: int = 10) -> DataFrame:
    top = by_words(spark, d).first(k)
    texts = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return top.join(texts, "doc_id").withColumn("n_words", tx.word_count(F.col("text")))


@query(f"""with {_CAND} select item_id, doc_id, first_rank, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from (
  select item_id, doc_id, rank as first_rank, {_OVERLAP} as score from cand join benchmark as b using (item_id) join documents as d using (doc_id) where rank <= 10)) where rank <= 3""")
def two_stage_rerank(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    both = candidates(spark, d).join(asked, "item_id")
    return search.reranked(both, "item_id", "doc_id", overlap_scorer(F.col("question"), F.col("text"))).select("item_id", "doc_id", "first_rank", "score", "rank")


@query(f"with {_CAND} select item_id, doc_id, rank from cand join labels using (doc_id) where rank <= 10 and quality = 1")
def relevance_filter(spark, d):
    """Labels stand in for a judge; a document without one is unread, which isn't a yes."""
    found = candidates(spark, d)
    verdicts = found.join(table(spark, d, "labels"), "doc_id").select("item_id", "rank", (F.col("quality") == 1).alias("answers"))
    return search.relevant(found, verdicts, "item_id").select("item_id", "doc_id", "rank")


@query(rf"""with {_CAND} select item_id, doc_id, n_words, rank, place from (select *, row_number() over (partition by item_id order by n_words, rank) as place from (
  select item_id, doc_id, rank, cast(len(regexp_extract_all(text, '\S+')) as bigint) as n_words from cand join documents using (doc_id) where rank <= 10)) where place <= 3""")
def shortest_first_top3(spark, d):
    return search.shortest_first(candidates(spark, d), "item_id").select("item_id", "doc_id", "n_words", "rank", "place")


@query(rf"""with {_CAND} select item_id, doc_id, round(score, 2) as match, lang as collection, source as book_name, array_to_string(w[1:110], ' ') || case when len(w) > 110 then ' ...' else '' end as text
  from (select *, regexp_extract_all(text, '\S+') as w from cand join documents using (doc_id) where rank <= 3)""")
def search_payload(spark, d):
    found = candidates(spark, d, 3)
    return found.select("item_id", "doc_id", F.round("score", 2).alias("match"), F.col("lang").alias("collection"), F.col("source").alias("book_name"), tx.preview(F.col("text")).alias("text"))


@query("""select doc_id, case lang when 'en' then 'English' when 'de' then 'German' else lang end || ' ' || cast(doc_id as varchar) || case when n_chars % 3 = 0 then '' when n_chars % 3 = 1 then ' — Book ' || cast(n_chars % 7 as varchar) else ' — Book ' || cast(n_chars % 7 as varchar) || ': ' || source end as cited,
  case when n_chars % 2 = 0 then 'cross-checked against the second source (similarity ' || printf('%.3f', (n_chars % 8) / 8.0) || ')' else 'single source' end as note from documents""")
def citation_format(spark, d):
    docs = table(spark, d, "documents")
    name = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "German").otherwise(F.col("lang"))
    book = F.when(F.col("n_chars") % 3 != 0, F.col("n_chars") % 7)
    title = F.when(F.col("n_chars") % 3 == 2, F.col("source"))
    note = tx.verification_note(F.col("n_chars") % 2 == 0, (F.col("n_chars") % 8) / 8.0, "the second source")
    return docs.select("doc_id", tx.citation(name, F.col("doc_id").cast("string"), book, title).alias("cited"), note.alias("note"))


# ---- alignment -------------------------------------------------------------------------------------


def _gram_tf(name, key, src_table):
    return f"""{name} as (select {key}, term, count(*) as tf from (select {key}, unnest(list_concat(t, list_transform(range(1, greatest(len(t) - 1, 0) + 1), lambda i: t[i] || ' ' || t[i + 1]))) as term from (select {key}, {TOK} as t from {src_table})) group by all)"""


_ALIGN = rf"""{_gram_tf("tf", "doc_id", "documents")}, n as (select count(*) as n from documents), idf as (select term, ln((1 + n) / (1 + count(*))) + 1 as idf from tf, n group by term, n),
  raw as (select doc_id, term, tf * idf as w from tf join idf using (term)), post as (select doc_id, term, w / sqrt(sum(w * w) over (partition by doc_id)) as weight from raw),
  {_gram_tf("qtf", "item_id", "benchmark")}, qraw as (select item_id, term, tf * idf as w from qtf join idf using (term)), qpost as (select item_id, term, w / sqrt(sum(w * w) over (partition by item_id)) as weight from qraw),
  score as (select item_id, doc_id, round(sum(p.weight * q.weight), 6) as similarity from qpost as q join post as p using (term) group by all),
  best as (select item_id, doc_id, similarity from (select *, row_number() over (partition by item_id order by similarity desc, doc_id) as r from score) where r = 1),
  won as (select *, row_number() over (partition by doc_id order by similarity desc, item_id) = 1 as first from best),
  matched as (select item_id, doc_id, similarity, case when first and similarity >= 0.8 then 'verified' when not first then 'contested' when similarity >= 0.6 then 'review' else 'unmatched' end as status,
    cast(len(regexp_extract_all(b.text, '\S+')) as bigint) as left_words, cast(len(regexp_extract_all(d.text, '\S+')) as bigint) as right_words from won join benchmark as b using (item_id) join documents as d using (doc_id))"""


def matches_of(spark, d) -> DataFrame:
    items, docs = table(spark, d, "benchmark").select("item_id", "text"), table(spark, d, "documents").select("doc_id", "text")
    left, right = items.withColumn("terms", ascii_terms()), docs.withColumn("terms", ascii_terms())
    found = align.best_matches(left, right, "item_id", "doc_id", pairs=True)
    found = staged(found.join(items.select("item_id", tx.word_count(F.col("text")).alias("left_words")), "item_id"), "found")
    met = found.select("doc_id").distinct()
    met = docs.join(F.broadcast(met) if few(met) else met, "doc_id", "left_semi").select("doc_id", tx.word_count(F.col("text")).alias("right_words"))
    found = found.join(met, "doc_id")
    return align.with_status(found, "item_id", "doc_id")


@query(f"with {_ALIGN} select item_id, doc_id, similarity from matched")
def align_best_match(spark, d):
    return matches_of(spark, d).select("item_id", "doc_id", "similarity")


@query(f"with {_ALIGN} select item_id, doc_id, status from matched")
def align_status(spark, d):
    return matches_of(spark, d).select("item_id", "doc_id", "status")


@query(f"""with {_ALIGN} select cast((select count(*) from benchmark) as bigint) as left_total, cast((select count(*) from documents) as bigint) as right_total, count(*) filter (where status = 'verified') as verified,
  count(*) filter (where status = 'review') as review, count(*) filter (where status = 'contested') as contested, count(*) filter (where status = 'unmatched') as unmatched from matched""")
def align_stats(spark, d):
    return align.match_stats(matches_of(spark, d), table(spark, d, "benchmark").count(), table(spark, d, "documents").count())


@query(f"""with {_ALIGN}, x as (select *, case when status = 'verified' then right_words - left_words end as delta from matched) select round(quantile_cont(similarity, 0.1), 6) as p10, round(quantile_cont(similarity, 0.5), 6) as p50, round(quantile_cont(similarity, 0.9), 6) as p90,
  round(avg(delta), 6) as delta_mean, cast(median(delta) as double) as delta_median, count(*) filter (where abs(delta) > 5) as far, round(avg(cast(abs(delta) > 5 as int)), 6) as far_share from x""")
def align_spread(spark, d):
    return align.similarity_spread(matches_of(spark, d))


@query(f"with {_ALIGN} select doc_id, m.doc_id is not null as verified, round(similarity, 4) as similarity, right_words - left_words as word_delta from documents left join (select * from matched where status = 'verified') as m using (doc_id)")
def verification_join(spark, d):
    return align.verified_records(table(spark, d, "documents").select("doc_id"), matches_of(spark, d), "doc_id").select("doc_id", "verified", "similarity", "word_delta")


@query(f"with {_ALIGN} select item_id, doc_id, similarity from matched where status <> 'verified' order by similarity, item_id, doc_id limit 10")
def align_flagged(spark, d):
    found = matches_of(spark, d).select("item_id", "doc_id", "similarity", "status")
    return found.where("status <> 'verified'").orderBy("similarity", "item_id", "doc_id").limit(10).drop("status")


# ---- replies ---------------------------------------------------------------------------------------


@query("""select conv_id, turn, [(conv_id % 2 = 0), case when turn % 3 = 0 then null else (turn % 2 = 0) end] as answers from conversations""")
def verdict_json_parse(spark, d):
    """Replies made of the numbers of a turn, the second verdict sometimes missing, some of them not
    quite JSON."""
    one = F.concat(F.lit('{"n": 1, "answers": '), (F.col("conv_id") % 2 == 0).cast("string"), F.lit(', "why": "a"}'))
    two = F.concat(F.lit('{"n": 2, "answers": '), (F.col("turn") % 2 == 0).cast("string"), F.lit(', "why": "b"}'))
    both = F.when(F.col("turn") % 3 == 0, one).otherwise(F.concat(one, F.lit(", "), two))
    raw = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("Verdicts: ["), both, F.lit(", oops]"))).otherwise(F.concat(F.lit("["), both, F.lit("]")))
    parsed = rules.parsed_verdicts(raw, F.lit(2))
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(parsed, lambda v: v.answers).alias("answers"))


@query("select conv_id, turn, [trim(text) || '?', 'b?'] as questions from conversations")
def question_list_parse(spark, d):
    return questions_of(table(spark, d, "conversations"))


def questions_of(turns: DataFrame) -> DataFrame:
    """Replies made of turns, of any text, and read again; a list with marks has no way to hold a line
    feed, so turns with one are always JSON."""
    asked = F.concat(F.trim("text"), F.lit("?"))
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.array(asked, F.lit("b?"))), F.lit("\n```"))
    listed = F.concat(F.lit("Here:\n1. "), asked, F.lit("\n- b?\n"))
    as_json = (F.col("turn") % 2 == 0) | F.col("text").rlike(r"[\n\r]")
    return turns.select("conv_id", "turn", rules.parsed_questions(F.when(as_json, fenced).otherwise(listed)).alias("questions"))


# ---- browsing --------------------------------------------------------------------------------------

TOPICS = [Topic("ones", ("^src1$", "^src1[0-4]$"), ("thth", "^the", "ing")), Topic("nines", ("9$",), ("er", "ent")), Topic("low", ("^src[0-3]$",), ("von", " de ", "the "))]
_TOPIC_OF = "select doc_id, text, unnest(list_filter([case when regexp_matches(source, '^src1$|^src1[0-4]$') then 'ones' end, case when regexp_matches(source, '9$') then 'nines' end, case when regexp_matches(source, '^src[0-3]$') then 'low' end], lambda x: x is not null)) as topic from documents where source is not null"
_HITS = lambda *p: " + ".join(f"cast(regexp_matches(t, '(?i){x}') as int)" for x in p)
_TOPIC = rf"""member as (select doc_id, topic, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from ({_TOPIC_OF})), uniq as (select * from (select *, row_number() over (partition by topic, lower(t) order by doc_id) as r from member) where r = 1),
  shown as (select doc_id, topic, len(regexp_extract_all(t, '\S+')) as n, least(3, case topic when 'ones' then {_HITS("thth", "^the", "ing")} when 'nines' then {_HITS("er", "ent")} else {_HITS("von", " de ", "the ")} end) as fit from uniq),
  topic_index as (select topic, doc_id, row_number() over (partition by topic order by case when n < 20 then 0 when n <= 120 then 2 when n <= 250 then 1 else 0 end desc, fit desc, n, doc_id) as place from shown)"""


def topics_of(spark, d) -> DataFrame:
    return browse.topic_index(table(spark, d, "documents"), TOPICS, "doc_id", book="source").select("topic", "doc_id", "place")


@query(f"with {_TOPIC} select topic, doc_id, place from topic_index")
def topic_index(spark, d):
    return topics_of(spark, d)


@query(f"with {_TOPIC} select topic, count(*) as n from topic_index group by topic")
def topic_listing(spark, d):
    return browse.topic_sizes(topics_of(spark, d))


@query(f"with {_TOPIC} select topic, doc_id, place from topic_index where topic = 'low' order by place limit 10 offset 5")
def topic_page(spark, d):
    return search.page(topics_of(spark, d).where("topic = 'low'"), ["place"], 5, 10)


@query(f"with {_TOPIC} select count(distinct doc_id) as reachable from topic_index")
def topic_reachable(spark, d):
    return topics_of(spark, d).agg(F.count_distinct("doc_id").alias("reachable"))


@query(rf"select doc_id, source from (select doc_id, source, row_number() over (partition by source, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) order by doc_id) as r from documents) where r = 1")
def dedupe_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5(F.lower(tx.collapsed(F.col("text")))).alias("key"))
    return docs.groupBy("source", "key").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source")


FEATURED = [5, 3, 999_999_999, 12, 7, 1]


@query("select place, doc_id, lang from (values (0, 5), (1, 3), (2, 999999999), (3, 12), (4, 7), (5, 1)) as v(place, doc_id) join documents using (doc_id)")
def featured_lookup(spark, d):
    return browse.featured(table(spark, d, "documents"), FEATURED, "doc_id", spark).select(F.col("place").cast("int").alias("place"), "doc_id", "lang")


@query("select cast(doc_id as bigint) as doc_id from (values (5), (3), (999999999), (12), (7), (1)) as v(doc_id) where doc_id not in (select doc_id from documents)")
def missing_ids(spark, d):
    return browse.missing_ids(table(spark, d, "documents"), FEATURED, "doc_id", spark)


_DAYS = "days as (select distinct cast(ts as date) as day from events), picks as (select day, cast(('0x' || sha256(cast(day as varchar))[1:8]) as bigint) % 27 as place from days)"


def picks_of(spark, d) -> DataFrame:
    """The picks of the days on which there were events."""
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return browse.daily_picks(days, [f"r{i}" for i in range(27)])


@query(f"with {_DAYS} select day, place, 'r' || cast(place as varchar) as pick from picks")
def daily_pick(spark, d):
    return picks_of(spark, d)


@query(f"with {_DAYS} select count(distinct place) as n from picks")
def daily_distinct(spark, d):
    return picks_of(spark, d).agg(F.count_distinct("pick").alias("n"))


# ---- usage -----------------------------------------------------------------------------------------


@query("select distinct user_id, sha256('salt|' || cast(user_id as varchar))[1:24] as pseudonym from events")
def anonymous_ids(spark, d):
    return table(spark, d, "events").select("user_id").distinct().select("user_id", tx.pseudonym("salt", F.col("user_id").cast("string")).alias("pseudonym"))


NAMES = {"view": "visit", "click": "search", "purchase": "answered", "error": "no_answer", "signup": "feedback"}
_EV = "ev as (select cast(ts as date) as d, case event_type when 'view' then 'visit' when 'click' then 'search' when 'purchase' then 'answered' when 'error' then 'no_answer' when 'signup' then 'feedback' end as e, case when user_id % 10 = 0 then '' else cast(user_id as varchar) end as v, event_id, ts from events)"


def usage_events(spark, d) -> DataFrame:
    """Events under the names of usage events; every tenth user has no name."""
    e = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    rows = table(spark, d, "events").select(F.to_date("ts").alias("d"), F.element_at(e, F.col("event_type")).alias("e"), F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string")).alias("v"), "event_id", "ts")
    return analytics.accepted(rows)


@query("with " + _EV + " select " + ", ".join(f"count(*) filter (where e = '{e}') as {e}, count(distinct v) filter (where e = '{e}' and v <> '') as {e}_people" for e in analytics.EVENTS[:7]) + ", count(distinct v) filter (where v <> '') as people, round(count(*) filter (where e = 'answered') / count(*) filter (where e = 'search'), 3) as answer_rate from ev where e is not null")
def event_totals(spark, d):
    return analytics.totals(usage_events(spark, d))


_DAILY = "select d, count(distinct v) filter (where v <> '') as people, " + ", ".join(f"count(*) filter (where e = '{e}') as {e}" for e in analytics.DAILY) + " from ev where e is not null group by d"


@query(f"with {_EV} {_DAILY}")
def event_daily(spark, d):
    return analytics.daily(usage_events(spark, d))


@query(f"with {_EV} select * from ({_DAILY}) order by d desc limit 14")
def event_recent_days(spark, d):
    return analytics.daily(usage_events(spark, d), last=14)


_CAP = f"""{_EV}, s as (select d as day, v as visitor, event_id as ord, v = '' or row_number() over (partition by d, v order by event_id) <= 1 as cand from ev where e = 'search'),
  u as (select *, coalesce(sum(cast(cand as int)) over (partition by day order by ord rows between unbounded preceding and 1 preceding), 0) as used from s),
  decided as (select day, visitor, ord, cand and used < 40 as admitted, case when cand and used < 40 then null when used >= 40 then 'site' else 'visitor' end as reason from u)"""


def decisions(spark, d) -> DataFrame:
    searches = usage_events(spark, d).where("e = 'search'").select(F.col("d").alias("day"), F.col("v").alias("visitor"), F.col("event_id").alias("ord"))
    return analytics.admitted(searches, per_day=40, per_visitor=1)


@query(f"with {_CAP} select day, visitor, ord, admitted, reason from decided")
def usage_cap_admission(spark, d):
    return decisions(spark, d).select("day", "visitor", "ord", "admitted", "reason")


@query(f"with {_CAP} select day, count(*) filter (where admitted) as used, greatest(0, 40 - count(*) filter (where admitted)) as remaining, count(distinct visitor) filter (where admitted and visitor <> '') as visitors, round(cast(count(*) filter (where admitted) as double) * 0.0014::double, 4) as spent from decided group by day")
def usage_status(spark, d):
    return analytics.usage(decisions(spark, d), per_day=40)


@query("select cast(coalesce(l_linenumber, 99) as bigint) as rank, count(*) as n, round(count(*) / (select count(*) from lineitem), 6) as share from lineitem group by 1")
def pick_rank_histogram(spark, d):
    return analytics.pick_ranks(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("rank")))


@query("""with vote as (select l_partkey as question, l_suppkey as chosen, count(*) as votes, min(l_orderkey * 10 + l_linenumber) as first from lineitem group by all)
  select question, arg_max(chosen, votes * 1000000000000 - first) as chosen, max(votes) as votes, cast(sum(votes) as bigint) as picks, count(*) > 1 as split from vote group by question""")
def pick_agreement(spark, d):
    picks = table(spark, d, "lineitem").select(F.col("l_partkey").alias("question"), F.col("l_suppkey").alias("chosen"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return analytics.pick_votes(picks, "question", "chosen", "ord")


@query("""with vote as (select l_orderkey as question, l_returnflag as chosen, count(*) as votes from lineitem group by all), agreed as (select question, min(chosen) as chosen, max(votes) as votes from vote group by question having count(*) = 1)
  select row_number() over (order by votes desc, question) as place, question, chosen, '{"query": "' || cast(question as varchar) || '", "expected_ids": ["' || cast(chosen as varchar) || '"], "expect": "pass"}' as line from agreed order by votes desc, question limit 20""")
def candidate_cases(spark, d):
    """Flags stand in for what was chosen: many an order has the same on all lines, so people agree on it."""
    picks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_returnflag").alias("chosen"), F.col("l_linenumber").alias("ord"))
    return evaluate.candidate_cases(analytics.pick_votes(picks, "question", "chosen", "ord"), "question", "chosen", 20)


@query("select l_orderkey, l_linenumber, list_position([l_partkey % 5, l_partkey % 7, l_suppkey % 3], l_linenumber) as position from lineitem")
def pick_position(spark, d):
    shown = F.array(F.col("l_partkey") % 5, F.col("l_partkey") % 7, F.col("l_suppkey") % 3)
    at = analytics.pick_position(shown, F.col("l_linenumber").cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", at.cast("int").alias("position"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def pending_work(spark, d):
    return expand.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")


@query("select doc_id, 'r' || cast(row_number() over (order by doc_id) - 1 as varchar) as request_id, true as valid from documents where doc_id not in (select doc_id from labels)")
def batch_ids(spark, d):
    numbered = expand.batch_ids(pending_work(spark, d), "doc_id")
    return numbered.select("doc_id", "request_id", F.col("request_id").rlike("^[a-zA-Z0-9_-]{1,64}$").alias("valid"))


@query("select event_id, cast(user_id as varchar) as by, event_type as kind from events order by event_id desc limit 50")
def feedback_tail(spark, d):
    return analytics.newest(table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("by"), F.col("event_type").alias("kind")), "event_id", 50)


# ---- evaluation ------------------------------------------------------------------------------------


@query(f"with {_VRANK}, f as (select query_id, min(rank) filter (where label = query_label) as first from vr group by query_id) select count(*) as queries, round(avg(cast(coalesce(first <= 1, false) as int)), 6) as recall_1, round(avg(cast(coalesce(first <= 3, false) as int)), 6) as recall_3, round(avg(coalesce(1.0 / first, 0)), 6) as mrr from f")
def eval_recall_at_k(spark, d):
    return evaluate.recall_at(vectors.first_relevant(*vectors_of(spark, d)))


_CASES = f"""{_VRANK}, cases as (select query_id, query_label, case when query_id % 300 = 0 then 'known_failure' else 'pass' end as expect, query_id % 500 = 0 as reject from (select vec_id as query_id, label as query_label from embeddings where vec_id % 100 = 0)),
  got as (select query_id, list(distinct label) as got from vr where rank <= 3 and score >= 0.3 group by query_id),
  result as (select c.query_id, expect, case when reject then got is null else coalesce(list_contains(got, query_label), false) end as ok from cases as c left join got using (query_id))"""


def case_results(spark, d) -> DataFrame:
    asked, rows = vectors_of(spark, d)
    best = vectors.nearest(asked, rows, 3).join(rows.select("vec_id", "label"), "vec_id")
    found = best.select("query_id", "rank", F.col("label").alias("answer"), (F.col("score") >= 0.3).alias("confident"))
    cases = asked.select("query_id", F.array("label").alias("expected"), F.when(F.col("query_id") % 300 == 0, "known_failure").otherwise("pass").alias("expect"), (F.col("query_id") % 500 == 0).alias("reject"))
    return evaluate.case_results(cases, found, "query_id")


@query(f"with {_CASES} select query_id, expect, ok from result")
def eval_cases(spark, d):
    return case_results(spark, d).select("query_id", "expect", "ok")


@query(f"with {_CASES} select count(*) filter (where expect = 'pass') as firm, count(*) filter (where expect = 'pass' and ok) as passed, count(*) filter (where expect = 'pass' and not ok) as regressions, count(*) filter (where expect <> 'pass' and not ok) as still_failing, count(*) filter (where expect <> 'pass' and ok) as now_passing from result")
def eval_summary(spark, d):
    return evaluate.summary(case_results(spark, d))


@query(f"with {_VSCORE}, b as (select query_id, max(score) filter (where vec_id % 2 = 0) as own, max(score) as every from vs group by query_id) select count(*) as questions, round(avg(own), 6) as own_mean, round(avg(every), 6) as both_mean, count(*) filter (where every > own) as improved, count(*) filter (where own >= 0.44) as own_over, count(*) filter (where every >= 0.44) as both_over from b")
def gold_gain(spark, d):
    asked, rows = vectors_of(spark, d)
    kinds = rows.select("vec_id", "vector", F.when(F.col("vec_id") % 2 == 0, "text").otherwise("question").alias("kind"))
    return evaluate.gain(vectors.greatest(asked, kinds), "query_id")


@query("""with a as (select doc_id, quality as first, quality + toxic as n from labels), b as (select doc_id, cast(n_chars % 2 as int) as first, cast(n_chars % 3 as int) as n from documents)
  select count(*) as questions, count(*) filter (where a.first is not distinct from b.first) as same_first, count(*) filter (where a.n = b.n) as same_count from a join b using (doc_id)""")
def provider_agreement(spark, d):
    a = table(spark, d, "labels").select("doc_id", F.col("quality").alias("first"), (F.col("quality") + F.col("toxic")).alias("n"))
    b = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("first"), (F.col("n_chars") % 3).cast("int").alias("n"))
    return analytics.agreement(a, b, "doc_id")


@query("select conv_id, turn, model, round(tokens_in / 1e6 * coalesce(pi, 5.0) + 400 / 1e6 * coalesce(po, 25.0), 6) as cost from (select conv_id, turn, role as model, length(text) // 4 as tokens_in from conversations) left join (values ('user', 1.0, 5.0), ('assistant', 3.0, 15.0)) as p(model, pi, po) using (model)")
def token_cost(spark, d):
    tokens = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("model"), F.expr("length(text) div 4").alias("tokens_in"), F.lit(400).alias("tokens_out"))
    prices = spark.createDataFrame([("user", 1.0, 5.0), ("assistant", 3.0, 15.0)], "model string, price_in double, price_out double")
    return analytics.cost(tokens, prices).select("conv_id", "turn", "model", "cost")


# ---- manifests, samples ----------------------------------------------------------------------------


@query("""select 'records' as name, count(*) as n_rows, cast(sum(length(text)) as bigint) as n_chars from documents union all select 'questions', count(*), cast(sum(length(text)) as bigint) from benchmark""")
def index_manifest(spark, d):
    parts = [table(spark, d, t).agg(F.lit(n).alias("name"), F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars")) for n, t in (("records", "documents"), ("questions", "benchmark"))]
    return parts[0].unionByName(parts[1])


@query()
def manifest_digests(spark, d):
    return sinks.manifest(spark, "model", {"records": table(spark, d, "documents"), "questions": table(spark, d, "benchmark")})


_ROW = "sha256(cast(item_id as varchar) || '|' || coalesce(text, ''))"
_SUMS = lambda row: " || '|' || ".join(f"cast(coalesce(sum(cast('0x' || {row}[{1 + 15 * i}:{15 + 15 * i}] as bigint)), 0) as varchar)" for i in range(4))


@query(f"select sha256('model|' || cast(count(*) as varchar) || '|' || {_SUMS(_ROW)})[1:16] as key, count(*) as n from benchmark")
def cache_key(spark, d):
    return src.content_key(table(spark, d, "benchmark"), "model", "text", "item_id")


@query("""with rest as (select doc_id, lang from documents where doc_id not in (1, 5, 9) order by md5(cast(doc_id as varchar) || '|7'), doc_id limit 50) select doc_id, lang from documents where doc_id in (1, 5, 9) union all select * from rest""")
def gold_plus_sample(spark, d):
    return expand.gold_and_sample(table(spark, d, "documents").select("doc_id", "lang"), [1, 5, 9], "doc_id", 50)


# ---- streams ---------------------------------------------------------------------------------------


def _event_source(spark, d) -> DataFrame:
    rows = table(spark, d, "events")
    e = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    stream = spark.readStream.schema(rows.schema).parquet(f"{d}/events.parquet*")
    return stream.select(F.to_date("ts").alias("d"), F.element_at(e, F.col("event_type")).alias("e"), F.col("user_id").cast("string").alias("v"), "event_id", "ts")


@query(f"with {_EV} select d, e, count(*) as n from ev where e is not null group by all")
def stream_daily_counts(spark, d):
    from ..streaming import daily_counts, run_once

    return run_once(daily_counts(analytics.accepted(_event_source(spark, d))), "stream_daily_counts", "complete")


def _searches(stream: DataFrame) -> DataFrame:
    return stream.where("e = 'search'").select(F.col("d").alias("day"), F.col("v").alias("visitor"), F.col("event_id").alias("ord"), "ts")


@query("select cast(ts as date) as day, cast(user_id as varchar) as visitor, event_id as ord, row_number() over (partition by cast(ts as date), user_id order by event_id) <= 3 as admitted from events where event_type = 'click'")
def stream_cap(spark, d):
    from ..streaming import caps

    return caps.capped_once(_searches(_event_source(spark, d)), per_visitor=3).drop("reason")


_OPEN_CAP = _CAP.replace("case when user_id % 10 = 0 then '' else cast(user_id as varchar) end as v", "cast(user_id as varchar) as v")


@query(f"with {_OPEN_CAP} select day, visitor, ord, admitted, reason from decided")
def stream_caps(spark, d):
    """Both caps, the visitor's and the site's, over the stream."""
    from ..streaming import caps

    return caps.capped_once(_searches(_event_source(spark, d)), per_visitor=1, per_day=40)


#: Each file of a micro-batch has about so many rows at least.
ROWS_OF_A_FILE = 50_000


def _in_batches(spark, d, batch, n: int) -> DataFrame:
    """The events as a stream of n micro-batches: batch is the number of an event's, a column."""
    from ..shared import new_folder

    folder = new_folder(spark, "batches")
    rows = table(spark, d, "events")
    sizes = rows.groupBy(batch.alias("batch")).count().collect()
    # of each the same number of files, as many as the smallest can fill, written one batch after another: the stream takes them by their time
    files = max(1, min(spark.sparkContext.defaultParallelism, min((r["count"] for r in sizes), default=0) // ROWS_OF_A_FILE)) if len(sizes) == n else 1
    for k in range(n):
        rows.where(batch == k).repartition(files).write.mode("append").parquet(folder)
    e = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.select(F.to_date("ts").alias("d"), F.element_at(e, F.col("event_type")).alias("e"), F.col("user_id").cast("string").alias("v"), "event_id", "ts")


@query(f"with {_OPEN_CAP} select day, visitor, ord, admitted, reason from decided")
def stream_caps_batches(spark, d):
    """The same over micro-batches of ten days each: the state of a day is dropped when it is over, and nothing is lost by that."""
    from ..streaming import caps

    stream = _in_batches(spark, d, F.least(F.lit(2), F.expr("(day(ts) - 1) div 10")), 3)
    return caps.capped_once(_searches(stream), per_visitor=1, per_day=40, late="1 hour")


#: Of every twenty events one comes in the second batch and one in the third, long after its day is closed.
_BATCH = "case event_id % 20 when 0 then 2 when 1 then 1 else 0 end"
_ON_TIME = f"""source as (select *, cast(ts as date) as d, {_BATCH} as batch from events), late as (select max(ts) filter (where batch = 0) - interval 1 day as before, max(ts) - interval 1 day as closed from source),
  on_time as (select source.*, case event_type when 'view' then 'visit' when 'click' then 'search' when 'purchase' then 'answered' when 'error' then 'no_answer' when 'signup' then 'feedback' end as e, closed from source, late where not (batch = 2 and d + interval 1 day <= before)),
  shut as (select * from on_time where d + interval 1 day <= closed)"""


@query(f"with {_ON_TIME} select d, e, count(*) as n from shut where e is not null group by all")
def stream_days(spark, d):
    """Counts of closed days by event time: what comes for a day that is closed is left out."""
    from ..streaming import daily_counts, run_once

    stream = _in_batches(spark, d, F.expr(_BATCH), 3)
    return run_once(daily_counts(analytics.accepted(stream), late="1 day"), "days")


@query(f"with {_ON_TIME} select d, count(distinct user_id) as people from shut where e is not null group by d")
def stream_people(spark, d):
    """Distinct visitors of closed days."""
    from ..streaming import daily_people, run_once

    stream = _in_batches(spark, d, F.expr(_BATCH), 3)
    return run_once(daily_people(analytics.accepted(stream), late="1 day"), "people")
