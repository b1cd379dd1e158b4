"""Answers that were once wrong, and parts that no query covers."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia import plugins
from marginalia.functions import rules
from marginalia.functions import text as tx
from marginalia.operators import align, analytics, search
from marginalia.plans import build, paths, retrieval
from marginalia.sources import records as src
from marginalia.sources import sinks
from marginalia.streaming import capped_once


def test_labels_are_of_the_grades_that_decided(spark):
    cases = [(["x", "x", "Daif"], "weak", "Daif"), (["dhaeef"], "weak", "dhaeef"), (["x", "Mawdu", "x"], "weak", "x"), (["Daif", "Hasan", "Daif"], "disputed", "Hasan (scholars differ)"), (["x", "Hasan", "x"], "sound", "Hasan")]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, g array<string>")
    got = {r.i: (r.x.verdict, r.x.label) for r in rows.select("i", rules.grade(F.col("g")).alias("x")).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


@pytest.mark.parametrize("text,narrator,rest", [
    ("src9 writes: a story", "src9", "a story"), ("As told by Ann bint Ben: a story", "Ann bint Ben", "a story"), ("As told by someone", None, "As told by someone"), ("He went home", None, "He went home"),
])
def test_attributions(spark, text, narrator, rest):
    a, b = tx.first_match(F.lit(text), paths.ATTRIBUTIONS)
    row = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert (row.a, row.b) == (narrator, rest)


def test_cross_references_and_passing_on_are_notes(spark):
    drop = ["As above, in the first book of the collection", "Similar to the report of his brother Ann", "It has been narrated through another chain of names", "Ann narrated this hadith on the authority of her father"]
    rows = spark.createDataFrame([(t,) for t in [*drop, "Asking is half of what there is to know"]], "t string")
    own = rules.NoteRules(openings=("^as above,", "^similar to ", "^it has been narrated", "^[a-z]+ narrated this"))
    assert {r.t for r in rows.where(rules.is_note(F.col("t"), own)).collect()} == set(drop)
    assert not rows.where(rules.is_note(F.col("t"), rules.NoteRules(openings=(), verbs="no such verb"))).collect()


def test_left_texts_without_a_shared_term_keep_their_place(spark):
    left = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, [])], "l int, terms array<string>")
    right = spark.createDataFrame([("r2", ["a", "b"]), ("r1", ["c"])], "r string, terms array<string>")
    got = {x.l: (x.r, x.similarity) for x in align.best_matches(left, right, "l", "r").collect()}
    assert got == {1: ("r2", 1.0), 2: ("r1", 0.0), 3: ("r1", 0.0)}
    stats = align.match_stats(align.with_status(align.best_matches(left, right, "l", "r"), "l", "r"), 3, 2).first()
    assert stats.verified + stats.review + stats.contested + stats.unmatched == 3


def test_equal_records_go_by_the_order_of_the_corpus(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, collection string, text string, grades array<string>, ord int")
    kept, _ = build.corpus([make([("b:9", "b", "the same words here", [], 0)]), make([("a:1", "a", "the same words here", [], 0)])])
    second = spark.createDataFrame([(1, None, "The same words here.")], "second_id int, narrator string, text string")
    records, matches = build.cross_checked(kept, second)
    assert {r.id: r.verified for r in records.collect()} == {"b:9": True, "a:1": False} and matches.first().status == "verified"
    with pytest.raises(ValueError, match="twice"):
        build.corpus([make([("a:1", "a", "x", [], 0), ("a:1", "a", "y", [], 1)])])


def test_the_last_line_of_the_last_file_wins(spark, tmp_path):
    long = "\n".join(json.dumps({"id": "a", "n": -i}) for i in range(3000))
    (tmp_path / "2.jsonl").write_text('{"id": "a", "n": 7}')
    (tmp_path / "1.jsonl").write_text(long + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = src.numbered(src.log_rows(spark, str(tmp_path), "id string, n long"))
        assert src.last_written(rows, "id", "ord", "n").first().n == 7
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pairs_don_t_cancel_in_digests(spark):
    make = lambda x: spark.createDataFrame([("k",), (x,), (x,)], "text string")
    assert sinks.table_digest(make("a")).first().digest != sinks.table_digest(make("b")).first().digest


def test_caps_of_visitor_and_site_over_micro_batches(spark, tmp_path):
    schema = "day string, visitor string, ord long"
    visits = [["a", "a", "b"], ["c", "", "a", "d"], ["e", "f"]]
    n, rows = 0, []
    for k, batch in enumerate(visits):
        own = [("d", v, n + i) for i, v in enumerate(batch)]
        n += len(own)
        rows += own
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
        for path in (tmp_path / f"{k}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            path.rename(tmp_path / "in" / f"{k}.parquet")
    got = {r.ord: (r.admitted, r.reason) for r in capped_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 1, per_day=4).collect()}
    want = analytics.admitted(spark.createDataFrame(rows, schema), per_day=4, per_visitor=1).collect()
    assert got == {r.ord: (r.admitted, r.reason) for r in want}
    assert [got[i] for i in (0, 1, 4, 5, 6)] == [(True, None), (False, "visitor"), (True, None), (False, "site"), (False, "site")]


def test_a_corpus_that_is_one_array(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "a:1", "text": "x\ny"}, {"id": "a:2", "text": None}], indent=1))
    got = src.json_corpus(spark, str(tmp_path / "c.json"), "id string, text string").collect()
    assert [(r.id, r.text) for r in got] == [("a:1", "x\ny"), ("a:2", None)]
    with pytest.raises(ValueError, match="no records"):
        (tmp_path / "e.json").write_text('{"metadata": {}, "hadiths": []}')
        src.editions(spark, str(tmp_path / "e.json"))


def test_pages_of_extracted_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ftwo\fthree")
    (tmp_path / "b.txt").write_text(" \n")
    rows = src.page_range(src.page_texts(spark, str(tmp_path)), 2, 3).orderBy("path").collect()
    assert [(r.text, r.problem) for r in rows] == [("two\fthree", None), (None, "empty")]


def test_without_an_encoder_nothing_is_called_confident(spark):
    records = spark.createDataFrame([("a", "The cat sat on the warm mat. It slept there all day long."), ("b", "Dogs bark at night when strangers come near the gate.")], "id string, text string")
    asked = spark.createDataFrame([(1, "where did the cat sleep")], "question_id long, text string")
    found = retrieval.answers(retrieval.build(records), asked).orderBy("rank").collect()
    assert found[0].id == "a" and [r.confident for r in found] == [None, None] and "vector_score" not in found[0].asDict()


def test_verdicts_of_a_judge_that_refuses_or_breaks(spark):
    rows = spark.createDataFrame([(1, "cats", r, f"text {r}", 10 - r) for r in range(1, 6)], "q int, question string, rank long, text string, n_words int")
    no = plugins.judged(rows, "q", "question", lambda prompt, n: (None, {}))
    assert all(r.answers is False and r.why == "refused" and not r.degraded for r in no.collect())
    assert search.shown(rows, no, "q").count() == 0
    odd = plugins.judged(rows, "q", "question", lambda prompt, n: ("I'd rather not say", {}))
    assert [(r["rank"], r.place) for r in search.shown(rows, odd, "q").orderBy("place").collect()] == [(1, 1), (2, 2), (3, 3)]
