"""Daily caps over a stream, with keyed state.

How many searches the visitors of a day have had is kept in a state store, under the day and a share of its visitors, so that a micro-batch
reads and writes a state for many visitors at once; a timer drops it when the day is over.  Of a micro-batch's searches of one visitor no more than
are left of the cap are held: a search that a smaller one displaces is refused at once.  What a day of the site has used is a small table of the days that are still open, one
snapshot a micro-batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shared import delete, new_folder, removed, staged

#: Keyed state with timers needs the store that Spark keeps in RocksDB.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000
#: In so many shares the visitors of a day are dealt, by a hash of their name.  It can't be changed while a checkpoint is in use.
SHARES = 64


@contextmanager
def state_store(spark: SparkSession):
    """The state store that keyed state needs, for streams that are started within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class VisitorCap(StatefulProcessor):
    """The first per_visitor searches of a visitor are candidates.  A key is a day and a share of its visitors."""

    def __init__(self, per_visitor: int, order: str):
        self.per_visitor, self.order = per_visitor, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "visitors array<string>, n array<long>")

    def _rows(self, key, visitors: list, orders: list, candidate: bool) -> pd.DataFrame:
        return pd.DataFrame({"day": [key[0]] * len(orders), "visitor": visitors, "ord": orders, "candidate": [candidate] * len(orders)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.used.exists()
        used = dict(zip(*self.used.get())) if known else {}
        held: dict[str, list] = {}  # a visitor's least orders, as a heap of their negatives
        for chunk in rows:
            who, refused = [], []
            for visitor, x in zip(chunk["visitor"].tolist(), chunk[self.order].tolist()):
                own = held.get(visitor)
                if own is None:
                    own = held[visitor] = []
                if len(own) < self.per_visitor - used.get(visitor, 0):
                    heapq.heappush(own, -x)
                    continue
                who.append(visitor)
                refused.append(-heapq.heapreplace(own, -x) if own and x < -own[0] else x)
            if refused:
                yield self._rows(key, who, refused, False)
        passed = [(visitor, -x) for visitor, own in held.items() for x in own]
        if passed:
            yield self._rows(key, [p[0] for p in passed], [p[1] for p in passed], True)
        for visitor, own in held.items():
            used[visitor] = used.get(visitor, 0) + len(own)
        self.used.update((list(used), list(used.values())))
        if not known:
            ends = int(pd.Timestamp(key[0]).value // 1_000_000) + DAY_MS
            # a day that is over already is only here until the next batch
            self.handle.registerTimer(max(ends, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def candidates(searches: DataFrame, per_visitor: int, late: str) -> DataFrame:
    """A stream of day, visitor, ord (long), ts with `candidate`: whether the visitor's own cap lets a search through.  Searches
    without a name are candidates and have no state; those that come `late` after what was seen, on a day that is over, are left out."""
    rows = searches.select("day", "visitor", F.col("ord").cast("long").alias("ord"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    named = F.col("visitor").isNotNull() & (F.col("visitor") != "")
    schema = f"day {dict(searches.dtypes)['day']}, visitor string, ord long, candidate boolean"
    shared = rows.where(named).withColumn("share", F.pmod(F.xxhash64("visitor"), F.lit(SHARES)))
    kept = shared.groupBy("day", "share").transformWithStateInPandas(VisitorCap(per_visitor, "ord"), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    nameless = rows.where(~F.coalesce(named, F.lit(False))).select("day", "visitor", "ord", F.lit(True).alias("candidate"))
    return kept.unionByName(nameless)


def capped_by_state(searches: DataFrame, folder: str, per_visitor: int, per_day: int | None = None, late: str = "1 day", open_days: int = 3):
    """A stream writer of day, visitor, ord, admitted, reason to folder/admitted from a stream of day (date), visitor, ord, ts.

    A visitor's first per_visitor searches of a day are candidates; of these the site's first per_day of a day pass, and
    from then on it is full.  Searches of a later micro-batch come after those of the ones before.  What a day has used is kept for
    the open_days latest days.  Batches are written under their own number, so one that is run again replaces itself."""
    spark = searches.sparkSession
    day = dict(searches.dtypes)["day"]
    spark.createDataFrame([], f"day {day}, used long").write.mode("ignore").parquet(f"{folder}/days/{-1}")

    def write(batch: DataFrame, number: int) -> None:
        rows = staged(batch, "candidates")
        if per_day is None:
            out = rows.withColumn("reason", F.when(~F.col("candidate"), "visitor"))
        else:
            out = of_the_site(rows, batch.sparkSession.read.schema(f"day {day}, used long").parquet(f"{folder}/days/{number - 1}"), number)
        out.select("day", "visitor", "ord", F.col("reason").isNull().alias("admitted"), "reason").write.mode("overwrite").parquet(f"{folder}/admitted/batch={number:010d}")
        removed(rows)

    def of_the_site(rows: DataFrame, days: DataFrame, number: int) -> DataFrame:
        # the search that fills a day is found among its first ones: tasks keep no more of a day than that
        nth = F.row_number().over(Window.partitionBy("day").orderBy("ord"))
        first = rows.where("candidate").withColumn("_nth", nth).where(F.col("_nth") <= per_day).join(days, "day", "left")
        first = first.where(F.col("_nth") <= per_day - F.coalesce("used", F.lit(0)))
        passed = first.groupBy("day").agg(F.max("ord").alias("_last"), F.count("*").alias("_n"))
        after = days.join(passed, "day", "full").select("day", F.coalesce("used", F.lit(0)).alias("_before"), "_last", (F.coalesce("used", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("used"))
        after = staged(after, "days")
        latest = after.agg(F.max("day").alias("_latest"))  # one row
        still = after.crossJoin(F.broadcast(latest)).where(F.date_add("day", open_days) > F.col("_latest"))
        still.select("day", "used").write.mode("overwrite").parquet(f"{folder}/days/{number}")
        # the batch before may be run again after a failure, those before that no more
        delete(rows.sparkSession, f"{folder}/days/{number - 2}")
        # full before this batch, or from the search on that used up what was left
        end = after.where(F.col("used") >= per_day).select("day", F.when(F.col("_before") < per_day, F.col("_last")).alias("_last"), F.lit(True).alias("_full"))
        both = rows.join(end, "day", "left")
        site = F.coalesce(F.col("_full") & (F.col("_last").isNull() | (F.col("ord") > F.col("_last"))), F.lit(False))
        return both.withColumn("reason", F.when(site, "site").when(~F.col("candidate"), "visitor"))

    stream = candidates(searches, per_visitor, late)
    return stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")


def capped_once(searches: DataFrame, per_visitor: int, per_day: int | None = None, late: str = "1 day") -> DataFrame:
    """capped_by_state for all that is there, and a read of what it wrote."""
    spark = searches.sparkSession
    folder = new_folder(spark, "capped")
    with state_store(spark):
        capped_by_state(searches, folder, per_visitor, per_day, late).trigger(availableNow=True).start().awaitTermination()
    schema = f"day {dict(searches.dtypes)['day']}, visitor string, ord long, admitted boolean, reason string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/admitted/batch=-1")
    return spark.read.schema(schema).parquet(f"{folder}/admitted").select("day", "visitor", "ord", "admitted", "reason")
