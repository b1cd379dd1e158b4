"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, queries_structure
from .contamination import contaminated, contamination
from .jaccard import similar_groups
from .languages import languages, train
from .licences import OWNER_MARKS, SPELLINGS, licences
from .neighbours import nearest_neighbours
from .packing import packed
from .passages import UNIT, WORD, without_passages
from .personal import BASE, personal_data
from .repeats import without_repeats
from .token_counts import token_counts
from .token_files import token_files


def packing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16,384 words, which SQL can count, where op1_packing counts tokens."""
    return packed(common.read(spark, sf_dir, "documents"), buckets=16, budget=16_384, granule=8)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(common.read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16,384 tokens."""
    counted = token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), frequent=0)
    return packed(counted, buckets=16, budget=16_384, granule=8, length=F.col("n_tokens"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_passages(common.read(spark, sf_dir, "documents"), words=25, least=6).withColumn("removed", _spelled("removed"))


def repeated_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of all whole lines that aren't empty."""
    return _without_repeats(spark, sf_dir, 0)


def repeated_lines_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of whole lines of eight words or more."""
    return _without_repeats(spark, sf_dir, 8)


def _spelled(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",")


def _without_repeats(spark: SparkSession, sf_dir: str, words: int) -> DataFrame:
    return without_repeats(common.read(spark, sf_dir, "documents"), words=words).select("doc_id", "n_lines", "n_removed", _spelled("removed").alias("removed"), "text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(common.read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(common.read(spark, sf_dir, "documents")).select("doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(common.read(spark, sf_dir, "documents"), k=3, threshold=(9, 10))


def held_out(doc_id="doc_id"):
    """The documents that language models never learn from; one without an id isn't among them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op10_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_neighbours, op3_repeats, op4_token_counts, op5_contamination,
        op6_personal_data, op7_licences, op8_token_files, op9_jaccard_groups, op10_languages,
        packing_words, repeated_lines_all, repeated_lines_long,
    )
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OP5_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
with item as (select item_id, {_OP5_WORDS} as words from benchmark where item_id is not null),
doc as (select doc_id, text, row_number() over () as row_no, {_OP5_WORDS} as words from documents),
win as (
  select distinct item_id, least(13, len(words)) as n, array_to_string(words[i : i + least(13, len(words)) - 1], ' ') as win
  from item, unnest(range(1, len(words) - least(13, len(words)) + 2)) as t(i) where len(words) > 0
),
place as (
  select row_no, i, z.n as n, array_to_string(words[i : i + z.n - 1], ' ') as win
  from doc, (select distinct n from win) as z, unnest(range(1, greatest(len(words) - z.n, -1) + 2)) as t(i)
),
hit as (select row_no, i, place.n as n, item_id from place join win using (n, win)),
word as (select row_no, count(distinct k) as n_hit from hit, unnest(range(i, i + n)) as t(k) group by row_no),
found as (select row_no, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct row_no, item_id from hit) group by row_no)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from doc left join word using (row_no) left join found using (row_no)
"""

OP9_SQL = f"""
with recursive doc as (
  select row_number() over () as row_no, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as words
  from documents
),
shingle as (
  select distinct row_no, array_to_string(words[i : i + least(3, len(words)) - 1], ' ') as s, least(3, len(words)) as w
  from doc, unnest(range(1, len(words) - least(3, len(words)) + 2)) as t(i) where len(words) > 0
),
size as (select row_no, count(*) as n from shingle group by row_no),
common_ as (select a.row_no as x, b.row_no as y, count(*) as c from shingle as a join shingle as b using (s, w) where a.row_no <> b.row_no group by all),
link as (select x, y from common_ join size as p on x = p.row_no join size as q on y = q.row_no where 100 * c >= 90 * (p.n + q.n - c)),
reach as (select row_no, row_no as other from doc union select r.row_no, y from reach as r join link on x = r.other)
select doc.doc_id, coalesce(n, 0) as n_shingles, least_id as component_id
from doc left join size using (row_no)
join (select r.row_no, min(d.doc_id) as least_id from reach as r join doc as d on r.other = d.row_no group by r.row_no) using (row_no)
"""

PACKING_WORDS_SQL = r"""
with recursive doc as (
  select doc_id, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as n_tokens from documents
),
sized as (select doc_id, n_tokens, cast(ceil(greatest(n_tokens, 1) / 8.0) as bigint) * 8 as padded from doc),
hist as (
  select padded, row_number() over (order by padded) as j,
    sum(count(*)) over (order by padded) as upto, sum(count(*) * padded) over (order by padded) as total
  from sized group by padded
),
dp as (
  select 1 as k, j, cast(padded * upto - total as hugeint) as cost, cast(0 as bigint) as cut from hist
  union all
  select k + 1, h.j, min(d.cost + h.padded * (h.upto - p.upto) - (h.total - p.total)),
    arg_min(d.j, (d.cost + h.padded * (h.upto - p.upto) - (h.total - p.total)) * 1000000 + d.j)
  from dp as d join hist as p on p.j = d.j join hist as h on h.j > d.j where k < 16 group by k + 1, h.j
),
final as (select k, j, cut from dp where j = (select max(j) from hist) order by cost, k limit 1),
back as (
  select k, j, cut from final
  union all
  select d.k, d.j, d.cut from back as b join dp as d on d.k = b.k - 1 and d.j = b.cut where b.k > 1
),
bounds as (select padded as bucket_length from back join hist using (j)),
placed as (select doc_id, n_tokens, (select min(bucket_length) from bounds where bucket_length >= padded) as bucket_length from sized),
numbered as (
  select *, row_number() over (partition by bucket_length order by doc_id, n_tokens) - 1 as place, greatest(1, 16384 // bucket_length) as each_ from placed
)
select doc_id, n_tokens, bucket_length, place // each_ as batch_no, place % each_ as slot from numbered
"""

_LINE = rf"trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g'))"
REPEATED_LINES_SQL = f"""
with line as (
  select doc_id, i - 1 as line_no, lines[i] as line, list_sum(list_transform(lines[1 : i - 1], lambda x: length(x) + 1)) as before
  from (select doc_id, string_split(text, chr(10)) as lines from documents), unnest(range(1, len(lines) + 1)) as t(i)
),
ranked as (
  select doc_id, line_no, coalesce(before, 0) as begins, line, {_LINE} as form,
    row_number() over (partition by {_LINE} order by doc_id, line_no) as nth
  from line
),
judged as (select *, nth > 1 and len(string_split(form, ' ')) >= 8 as gone from ranked)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
  coalesce(string_agg(cast(cast(begins as bigint) as varchar) || ':' || cast(cast(begins + length(line) as bigint) as varchar), ',' order by line_no) filter (where gone), '') as removed,
  coalesce(string_agg(line, chr(10) order by line_no) filter (where not gone), '') as text
from judged group by doc_id
union all
select doc_id, 0, 0, '', null from documents where text is null
"""


def _op7_form(text: str, lines: bool = True) -> str:
    marks = " or ".join(f"contains(x, '{m}')" for m in OWNER_MARKS)
    lower = f"lower({text})"
    kept = f"array_to_string(list_filter(string_split({lower}, chr(10)), lambda x: not ({marks})), chr(10))" if lines else f"case when {marks.replace('x,', lower + ',')} then '' else {lower} end"
    # two spaces between words: spellings of neighbours need one each
    form = rf"' ' || regexp_replace({kept}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g') || ' '"
    for a, b in SPELLINGS:
        form = f"replace({form}, ' {'  '.join(a.split())} ', ' {'  '.join(b.split())} ')"
    return f"trim(regexp_replace({form}, ' +', ' ', 'g'))"


def _op7_sql() -> str:
    from pathlib import Path

    known, name, held = [], None, []
    for line in [*(Path(__file__).parent / "licence_texts.txt").read_text().split("\n"), "=== "]:
        if line.startswith("=== "):
            if name:
                known.append((name, "\n".join(held).strip("\n")))
            name, held = line[4:].strip(), []
        else:
            held.append(line)
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known)
    return f"""
with known as (select sha256({_op7_form("text")}) as digest, min(licence) as licence from (values {values}) as v(licence, text) group by 1),
doc as (select row_number() over () as row_no, doc_id, text, {_op7_form("text")} as form from documents),
line as (select doc_id, {_op7_form("line", False)} as form from (select doc_id, unnest(string_split(text, chr(10))) as line from documents)),
noted as (select doc_id, string_agg(distinct licence, ',' order by licence) as notices from line join known on sha256(form) = digest where form <> '' group by doc_id)
select doc_id, d.digest, licence, coalesce(notices, '') as notices
from (select row_no, doc_id, case when form <> '' then sha256(form) end as digest from doc) as d left join known on d.digest = known.digest left join noted using (doc_id)
"""


_FORM = rf"trim(regexp_replace(translate(u, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g'))"
OP3_SQL = f"""
with unit as (
  select doc_id, i, us[i] as u, {_FORM.replace("translate(u,", "translate(us[i],")} as form, cast(len(regexp_extract_all(us[i], '{WORD}')) as bigint) as n
  from (select doc_id, regexp_extract_all(text, '{UNIT}') as us from documents where doc_id is not null), unnest(range(1, len(us) + 1)) as t(i)
),
placed as (
  select *, sum(n) over (partition by doc_id order by i) - n as n_before, sum(n) over (partition by doc_id) as n_all,
    coalesce(sum(length(u)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as begins
  from unit
),
worded as (select doc_id, i, n_before, n_before + n as n_upto, n_all, form from placed where n > 0),
whole as (
  select w.doc_id, w.i as a, v.i as b from (select * from worded where n_all - n_before >= 6) as w
  asof join worded as v on w.doc_id = v.doc_id and w.n_before + 6 <= v.n_upto
),
last as (
  select w.doc_id, v.i as a, w.i as b
  from (select *, n_all - 6 as room from worded where n_upto = n_all and n_all >= 6 and n_all - n_before < 6) as w
  asof join worded as v on w.doc_id = v.doc_id and w.room >= v.n_before
),
formed as (
  select s.doc_id, a, b, string_agg(form, ' ' order by i) as form
  from (select * from whole union select * from last) as s join worded as w on s.doc_id = w.doc_id and i between a and b group by all
),
later as (select doc_id, a, b from (select *, row_number() over (partition by form order by doc_id, a) as nth from formed) where nth > 1),
covered as (select distinct p.doc_id, i from placed as p join later as l on p.doc_id = l.doc_id and i between a and b),
run as (
  select p.*, c.i is not null or n = 0 as inside, sum(case when c.i is null and n > 0 then 1 else 0 end) over (partition by p.doc_id order by p.i) as k
  from placed as p left join covered as c on p.doc_id = c.doc_id and p.i = c.i
),
judged as (select *, inside and sum(n) filter (where inside) over (partition by doc_id, k) >= 25 as gone from run),
passage as (
  select doc_id, k, sum(n) as n, min(begins) as begins, max(begins + length(u)) as ends from judged where gone group by doc_id, k
),
lost as (
  select doc_id, count(*) as n_removed, sum(n) as n_words_removed,
    string_agg(cast(cast(begins as bigint) as varchar) || ':' || cast(cast(ends as bigint) as varchar), ',' order by begins) as removed
  from passage group by doc_id
),
kept as (select doc_id, string_agg(u, '' order by i) filter (where not gone) as text from judged group by doc_id)
select doc_id, n_removed is not null as has_repeats, coalesce(n_removed, 0) as n_removed, cast(coalesce(n_words_removed, 0) as bigint) as n_words_removed,
  coalesce(removed, '') as removed, case when d.text is not null then coalesce(k.text, '') end as text
from documents as d left join lost using (doc_id) left join kept as k using (doc_id)
"""

ORACLE_SQL = {"packing_words": PACKING_WORDS_SQL, "op3_repeats": OP3_SQL, "repeated_lines_long": REPEATED_LINES_SQL, "op7_licences": _op7_sql(), "op5_contamination": OP5_SQL, "op9_jaccard_groups": OP9_SQL}
#: The same rows for lines of any length: only the condition on the words of a line is another.
ORACLE_SQL["repeated_lines_all"] = REPEATED_LINES_SQL.replace("len(string_split(form, ' ')) >= 8", "form <> ''")

QUERIES |= queries_structure.QUERIES
ORACLE_SQL |= queries_structure.ORACLE_SQL
