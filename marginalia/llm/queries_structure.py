"""Queries of the operators for archives, conversations and phrases, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common
from .archives import read_archives, write_archives
from .conversations import conversation_repairs, damaged, with_all
from .phrases import collocations


def op11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "archives")
    files = write_archives(common.read(spark, sf_dir, "pages"), folder, least_bytes=0)
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP11_SQL = """
with page as (select page_id, coalesce(html, '') as html, row_number() over () as row_no from pages),
summed as (
  select page_id, strlen(html) as size, list_transform(range(8), lambda i: cast('0x' || sha1(html)[5 * i + 1 : 5 * i + 5] as int)) as fives,
    row_number() over w as nth, first_value(page_id) over w as last_id
  from page window w as (partition by html order by page_id desc nulls last, row_no)
)
select page_id, cast(size as bigint) as payload_bytes,
  array_to_string(list_transform(fives, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((x >> b) & 31) + 1]), '')), '') as payload_digest,
  case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then last_id end as refers_to
from summed
"""


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = common.read(spark, sf_dir, "conversations")
    return with_all(conversations, conversation_repairs(damaged(conversations)))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"), length=4, least=30, inside=80, best=2000)


OP13_SQL = r"""
with piece as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)
),
size as (select lang, cast(sum(len(w)) as bigint) as n from piece group by lang),
known as (
  select lang, phrase, k, count(*) as f
  from (select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from piece, range(1, 5) as x(k), unnest(range(1, len(w) - k + 2)) as t(i))
  group by all having count(*) >= 30
),
candidate as (select lang, phrase, f as a, k, string_split(phrase, ' ') as w from known where k >= 2),
longer as (
  select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as longest
  from candidate, unnest(range(2, k)) as x(m), unnest(range(1, k - m + 2)) as t(i) group by all
),
kept as (select c.* from candidate as c left join longer using (lang, phrase) where longest is null or 100 * cast(longest as hugeint) < 80 * cast(a as hugeint)),
cut as (
  select kept.lang, kept.phrase, a, j, p.f as l, q.f as r, cast(2000000 * cast(a as hugeint) // (cast(p.f as hugeint) + q.f) as bigint) as score
  from (select *, unnest(range(1, k)) as j from kept) as kept
  join known as p on p.lang = kept.lang and p.phrase = array_to_string(w[1 : j], ' ')
  join known as q on q.lang = kept.lang and q.phrase = array_to_string(w[j + 1 : kept.k], ' ')
),
least_ as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score from least_)
select lang, rank, phrase, a, l, r, n, score from ranked join size using (lang) where rank <= 2000
"""


def _op12_sql() -> str:
    way = lambda cost, edit, line, then: f"{{'c': {then}.c + {cost}, 'a': '{edit}' || {then}.a, 't': {line} || {then}.t}}"
    line, user, assistant = "chr(10) || role || ':' || text", "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    least = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda x: x is not null))[1]"

    def turn(state: int, kept: dict[str, int], to: int) -> str:
        """The best way from a state that begins with an edit of this turn."""
        name = "user" if to == 2 else "assistant"
        rerole = f"case when fate < 2 then {way('1 + 5 * fate', 'R', f'chr(10) || {chr(39)}{name}:{chr(39)} || text', f'f{to}')} end"
        keeps = [f"case when fate < 2 and initial = '{i}' then {way('5 * fate', 'K', line, f'f{k}')} end" for i, k in kept.items()]
        return f"{least(way(2, 'D', chr(39) * 2, f'f{state}'), rerole, *keeps)} as g{state}"

    turns = ", ".join([turn(0, {"s": 1, "u": 2}, 2), turn(1, {"u": 2}, 2), turn(2, {"a": 3}, 3), turn(3, {"u": 2}, 2)])
    opened = lambda s: f"{least(f'g{s}', way(5, 'I', user, 'g2'), way(10, 'II', f'{user} || {assistant}', 'g3'))} as f{s}"
    closed = f"{opened(0)}, {opened(1)}, {least('g2', way(5, 'I', assistant, 'g3'))} as f2, {least('g3', way(5, 'I', user, 'g2'))} as f3"
    end = lambda cost, edits, lines: f"{{'c': cast({cost} as bigint), 'a': '{edits}', 't': {lines}}}"
    ends = f"{end(0, '', chr(39) * 2)} as f0, {end(10, 'II', f'{user} || {assistant}')} as f1, {end(5, 'I', assistant)} as f2, {end(0, '', chr(39) * 2)} as f3"
    return f"""
with recursive bit(i, k, c) as (
  select i, 0, cast(i as bigint) from range(256) as t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end from bit where k < 8
),
tab as (select list(c order by i) as tab from bit where k = 8),
named as (
  select dense_rank() over (order by conv_id nulls first) as g, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations
),
dealt as (
  select named.*, xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(key, ''), lambda x: cast(ord(x) as bigint))),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 as kind from named, tab
),
hurt as (
  select g, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from dealt, range(case when kind = 3 then 2 else 1 end) where kind <> 0
),
placed as (select *, row_number() over (partition by g order by turn nulls first, role, substr(text, 1, 64), md5(text)) as i, substr(role, 1, 1) as initial from hurt),
faulty as (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
    when row_number() over (partition by g, role, text order by i) > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault,
    lag(initial) over (partition by g order by i) || initial as pair
  from placed
),
row_ as (select *, case fault when '' then 0 when 'truncated' then 1 else 2 end as fate from faulty),
counts as (
  select g, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from row_ group by g
),
best as (
  select g, n + 1 as i, {ends} from counts
  union all
  select g, i, {closed} from (select r.g, r.i, {turns} from best as b join row_ as r on r.g = b.g and r.i = b.i - 1)
)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(b.f0.c, 0) as cost, coalesce(b.f0.a, '') as audit, sha256(coalesce(substr(b.f0.t, 2), '')) as repaired_sha256
from (select distinct g, conv_id from named) as ids left join counts using (g) left join best as b on b.g = ids.g and b.i = 1
"""


QUERIES = {f.__name__: f for f in (op11_archives, op12_conversation_repair, op13_phrases)}
ORACLE_SQL = {"op11_archives": OP11_SQL, "op12_conversation_repair": _op12_sql(), "op13_phrases": OP13_SQL}
