"""The pipeline against a plain version of its stages, and the queries with SQL."""

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

import __spark_entry__ as entry
import corpus_pipeline
from marginalia.llm import common, personal
from marginalia.llm.languages import Labeler, train
from marginalia.llm.queries import ORACLE_SQL, QUERIES, held_out
from tests.llm.test_contamination import plain as plain_hits
from tests.llm.test_jaccard import plain as plain_groups
from tests.test_queries import TABLES, rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.sql(ORACLE_SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(found.columns, found.fetchall())


def test_pipeline(spark):
    docs = common.read(spark, SF, "documents")
    bench = [tuple(r) for r in common.read(spark, SF, "benchmark").select("item_id", "text").collect()]
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    labeler = Labeler(train(docs, ~held_out()))
    paths, counts = labeler.label([t for _, t in rows])
    share = lambda p, c: max(c[p == k].sum() for k in set(p.tolist())) / c.sum() if len(p) and c.sum() else 0
    rows = [r for r, p, c in zip(rows, paths, counts) if share(p, c) >= 0.5]
    groups = {d: g for d, _, g in plain_groups(rows, 5, 4, 5)}
    rows = [(d, t) for d, t in rows if groups[str(d)] == str(d)]
    bad = {d for d, n, hit, _ in plain_hits(rows, bench) if hit and 20 * hit >= n}
    rows = [(d, t) for d, t in rows if str(d) not in bad]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == [d for d, _ in rows] and bad
    weights = personal.train(spark.createDataFrame(rows, "doc_id long, text string"))
    library = Library.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {d: len(library.encode(personal.masked(t, personal.spans_of(t, weights)), add_special_tokens=False).ids) for d, t in rows}
    assert {r.doc_id: r.n_tokens for r in got} == tokens


def test_stages_keep_columns(spark):
    docs = common.read(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes, name
    assert entry.queries()["pipeline"]
