"""Votes against the SQL of pick_agreement where picks lack a choice or an order, and ties that it leaves open."""

import duckdb

import __spark_entry__ as entry
from marginalia.operators import analytics


def test_nulls_as_in_sql(spark, tmp_path):
    rows = [(1, 7, None, 1), (2, 7, None, 1), (3, 7, 5, 1), (None, 8, 4, 1), (9, 8, 6, 1), (1, 9, None, 1), (4, None, 2, 1), (5, None, 3, 1), (6, None, 3, 1), (None, 10, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    found = con.sql(entry.oracle_sql()["pick_agreement"])
    got = entry.queries()["pick_agreement"](spark, str(tmp_path)).select(*found.columns)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, found.fetchall()))


def test_a_tie_goes_to_the_smallest_choice(spark):
    rows = [(1, c, 10) for c in (9, 4, 6, 8)]
    for n in (1, 4):
        df = spark.createDataFrame(rows, "q long, c long, o long").repartition(n)
        assert [tuple(r) for r in analytics.pick_votes(df, "q", "c", "o").collect()] == [(1, 4, 1, 4, True)]
