"""Caps with keyed state, days by event time, and what comes too late."""

import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.operators import analytics
from marginalia.streaming import caps, daily_counts, daily_people, late_rows

SCHEMA = "ts timestamp, visitor string, ord long"


@pytest.fixture
def batches(spark, tmp_path):
    """A stream that has each list of rows as a micro-batch."""

    def make(parts, schema=SCHEMA):
        (tmp_path / "in").mkdir()
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
            for path in (tmp_path / f"part{k}").glob("*.parquet"):
                target = tmp_path / "in" / f"{k}.parquet"
                path.rename(target)
                import os

                os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def at(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_state_is_dropped_when_a_day_is_over(spark, batches, tmp_path):
    rows = [[(at(day, h), v, 100 * day + h) for h, v in enumerate(["a", "a", "b", "", "c", None, "d"])] for day in range(1, 5)]
    stream = batches(rows).withColumn("day", F.to_date("ts"))
    folder = str(tmp_path / "out")
    with caps.state_store(spark):
        caps.capped_by_state(stream, folder, per_visitor=1, per_day=3, late="1 hour", open_days=2).trigger(availableNow=True).start().awaitTermination()
    got = {r.ord: (r.admitted, r.reason) for r in spark.read.parquet(f"{folder}/admitted").collect()}
    searches = spark.createDataFrame([r for day in rows for r in day], SCHEMA).withColumn("day", F.to_date("ts")).na.fill("", ["visitor"])
    want = {r.ord: (r.admitted, r.reason) for r in analytics.admitted(searches, per_day=3, per_visitor=1).collect()}
    assert got == want
    left = spark.read.format("statestore").option("stateVarName", "used").load(f"{folder}/checkpoint").select("key.day").distinct().collect()
    assert [r.day for r in left] == [datetime.date(2024, 1, 4)]
    import os

    newest = max(int(x) for x in os.listdir(f"{folder}/days"))
    assert len(os.listdir(f"{folder}/days")) <= 2 and {r.day.day for r in spark.read.parquet(f"{folder}/days/{newest}").collect()} == {3, 4}


def test_a_day_goes_on_over_batches(spark, batches):
    rows = [[(at(1, 1), "a", 1), (at(1, 2), "b", 2), (at(1, 3), "a", 3)], [(at(1, 4), "a", 4), (at(1, 5), "c", 6), (at(1, 5), "b", 5)], [(at(1, 6), "d", 7), (at(1, 7), "b", 8), (at(1, 8), "", 9)]]
    stream = batches(rows).withColumn("day", F.to_date("ts"))
    got = {r.ord: (r.admitted, r.reason) for r in caps.capped_once(stream, per_visitor=2, per_day=6).collect()}
    searches = spark.createDataFrame([r for part in rows for r in part], SCHEMA).withColumn("day", F.to_date("ts"))
    assert got == {r.ord: (r.admitted, r.reason) for r in analytics.admitted(searches, per_day=6, per_visitor=2).collect()}


def test_a_visitor_with_many_searches_is_held_by_the_cap_alone(spark, batches):
    n = 25_000
    rows = [(at(1), "hot", n - i) for i in range(n)] + [(at(1), "cold", -1)]
    got = caps.capped_once(batches([rows]).withColumn("day", F.to_date("ts")), per_visitor=3)
    assert got.count() == n + 1 and sorted(r.ord for r in got.where("admitted").collect()) == [-1, 1, 2, 3]


def test_empty_stream(spark, batches):
    assert caps.capped_once(batches([[]]).withColumn("day", F.to_date("ts")), per_visitor=3).collect() == []


def test_what_comes_too_late_is_left_out_and_counted(spark, batches, tmp_path):
    schema = "ts timestamp, v string, e string"
    parts = [[(at(1, 1), "a", "x"), (at(1, 2), "a", "x"), (at(1, 3), "b", "y"), (at(4, 1), "a", "x")], [(at(4, 2), "a", "x"), (at(3, 2), "a", "x")], [(at(1, 9), "z", "x"), (at(4, 3), "c", "y"), (at(6, 1), "c", "y")]]
    found = {}
    stream = batches(parts, schema)
    for name, df in (("counts", daily_counts(stream, late="1 day")), ("people", daily_people(stream, late="1 day"))):
        out = str(tmp_path / name)
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-c").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert late_rows(query) == 1
        found[name] = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    day = lambda d: datetime.date(2024, 1, d)
    assert found["counts"] == [(day(1), "x", 2), (day(1), "y", 1), (day(3), "x", 1), (day(4), "x", 2), (day(4), "y", 1)]
    assert found["people"] == [(day(1), 2), (day(3), 1), (day(4), 2)]


@pytest.mark.parametrize("seconds", [1])
def test_an_interval_trigger_takes_up_new_files(spark, tmp_path, seconds):
    """A stream that runs on by its clock finds what is added later."""
    import time

    from marginalia.streaming import event_stream, log_to

    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    add = lambda n: spark.createDataFrame([(datetime.date(2024, 1, 1), "search", f"v{n}" * 30)], "d date, e string, v string").write.mode("append").json(source)
    add(1)
    query = log_to(event_stream(spark, source), log, str(tmp_path / "checkpoint"), every=f"{seconds} seconds").start()
    try:
        for n in (1, 2):
            until = time.time() + 60
            while time.time() < until:
                try:
                    if spark.read.schema("d date, e string, v string").json(log).count() == n:
                        break
                except Exception:  # noqa: BLE001  the log isn't there yet
                    pass
                time.sleep(0.3)
            assert spark.read.schema("d date, e string, v string").json(log).count() == n
            add(2)
        assert len(query.recentProgress) >= 2
    finally:
        query.stop()


def test_visitors_share_states(spark, batches, tmp_path):
    """A state for each visitor would be a call for each of them."""
    rows = [[(at(1, h), f"v{i}", 3000 * h + i) for i in range(3000) for h in (1, 2)], [(at(1, 3), f"v{i}", 9000 + i) for i in range(3000)]]
    stream = batches(rows).withColumn("day", F.to_date("ts"))
    folder = str(tmp_path / "out")
    with caps.state_store(spark):
        caps.capped_by_state(stream, folder, per_visitor=2).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.ord for r in spark.read.parquet(f"{folder}/admitted").where("admitted").collect()) == list(range(3000, 9000))
    states = spark.read.format("statestore").option("stateVarName", "used").load(f"{folder}/checkpoint")
    assert states.count() <= 64
