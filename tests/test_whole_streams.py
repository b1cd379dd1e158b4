import pytest
from pyspark.sql import functions as F

from marginalia.plans import catalogue
from marginalia.streaming import capped_once, run_once


def test_cap_goes_by_order_beyond_one_arrow_batch(spark, tmp_path):
    rows = [("d1", "hot", 25_000 - i) for i in range(25_000)] + [("d1", "", i) for i in range(5)] + [("d2", "cold", i) for i in range(2)] + [("d1", None, i) for i in range(5)]
    schema = "day string, visitor string, ord long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = capped_once(stream(), per_visitor=3)
    assert got.count() == len(rows)
    let = sorted((str(r.visitor), r.ord) for r in got.where("admitted").collect())
    assert let == sorted([("hot", 1), ("hot", 2), ("hot", 3), *(("", i) for i in range(5)), ("cold", 0), ("cold", 1), *(("None", i) for i in range(3))])
    assert run_once(stream(), "whole").count() == len(rows) and not spark.catalog.tableExists("whole")


def test_cap_holds_over_micro_batches(spark, tmp_path):
    schema = "day string, visitor string, ord long"
    for k in range(3):
        spark.createDataFrame([("d", "a", 10 * k + i) for i in range(2)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = capped_once(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), per_visitor=3)
    assert got.count() == 6 and got.where("admitted").count() == 3


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_every_turn_is_read_again(spark, sf):
    turns = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    odd = spark.createDataFrame([(-1, 0, 'say "a"\nthen \\b ] and [x'), (-2, 1, "one\r\ntwo"), (-3, 1, 'c:\\d "q"')], "conv_id long, turn int, text string")
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), "text").unionByName(odd)
    both = catalogue.questions_of(turns).join(turns, ["conv_id", "turn"])
    assert turns.where("contains(text, '\n')").count() > 2
    assert both.count() == turns.count() and both.where(~F.col("questions").eqNullSafe(F.array(F.concat(F.trim("text"), F.lit("?")), F.lit("b?")))).count() == 0
