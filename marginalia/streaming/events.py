"""Structured Streaming over event logs: append, mirror, daily counts and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.analytics import accepted
from ..shared import delete, new_folder, staged

LOG = "d date, e string, v string"


def event_stream(spark: SparkSession, path: str, schema: str = LOG, form: str = "json", **options) -> DataFrame:
    return spark.readStream.schema(schema).format(form).options(**options).load(path)


def log_to(events: DataFrame, path: str, checkpoint: str, every: str = "5 seconds"):
    """Accepted events, with visitors cut to 32 characters, appended to a log."""
    rows = accepted(events).withColumn("v", F.substring("v", 1, 32))
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every)


def mirror_to(events: DataFrame, folder: str, checkpoint: str, every: str = "5 seconds"):
    """Micro-batches written under their own number: a batch that is run again replaces itself, so a
    retry after a failure adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number:010d}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every)


def daily_counts(events: DataFrame, day: str = "d", event: str = "e", late: str | None = None, ts: str = "ts") -> DataFrame:
    """Counts by day and event.  With `late` the stream has a timestamp and days close that much later."""
    if late is None:
        return events.groupBy(day, event).agg(F.count("*").alias("n"))
    windows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, "1 day"), event).agg(F.count("*").alias("n"))
    return windows.select(F.to_date("window.start").alias(day), event, "n")


def daily_people(events: DataFrame, late: str, day: str = "d", visitor: str = "v", ts: str = "ts") -> DataFrame:
    """How many visitors with a name a day had, by event time: a row when a day is closed, that is `late` after its
    end.  The state is one row for each visitor of a day that is still open; what comes for a closed day is left out."""
    named = events.where(F.length(visitor) > 0).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).withColumn("window", F.window(ts, "1 day"))
    once = named.dropDuplicates(["window", visitor])
    return once.groupBy("window").agg(F.count("*").alias("people")).select(F.to_date("window.start").alias(day), "people")


def late_rows(query) -> int:
    """How many rows a stream has left out so far because they came too late."""
    return sum(int(state["numRowsDroppedByWatermark"]) for progress in query.recentProgress for state in progress["stateOperators"])


def capped_to(searches: DataFrame, folder: str, per_visitor: int, day: str = "day", visitor: str = "visitor", order: str = "ord", per_day: int | None = None):
    """Searches of a stream with whether the visitor's daily cap, and that of the site if it is given, let them
    through, and if not which one stopped them, written to folder/admitted; visitors without a name have no cap
    of their own, and only searches that the visitor's cap lets through count for the site's.

    This is for streams without event time: a micro-batch is ranked by Spark's own sort, after the number of searches of that day
    and visitor in the batches before.  These numbers are a table of which each batch reads the last snapshot and writes the next; days
    are never closed, so it grows with visitors and days.  caps.capped_by_state, which needs a timestamp, has keyed state that ends with
    the day.  Batches are written under their own number, so one that is run again replaces itself.  Searches that come in a later batch come
    after."""
    kinds = dict(searches.dtypes)
    counts, key = f"{folder}/counts", [day, visitor]
    schema = f"`{day}` {kinds[day]}, `{visitor}` {kinds[visitor]}, _n long"
    searches.sparkSession.createDataFrame([], schema).write.mode("ignore").parquet(f"{counts}/batch=-1")
    days = f"`{day}` {kinds[day]}, _n long"
    searches.sparkSession.createDataFrame([], days).write.mode("ignore").parquet(f"{folder}/days/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*key, order)
        named = ~F.col(visitor).eqNullSafe(F.lit(""))
        place = F.row_number().over(Window.partitionBy(*key).orderBy(order))
        ranked = rows.where(named).withColumn("_place", place)
        known = spark.read.schema(schema).parquet(f"{counts}/batch={number - 1}")
        before = known.select(F.col(day).alias("_day"), F.col(visitor).alias("_visitor"), F.col("_n").alias("_before"))
        ranked = ranked.join(before, F.col(day).eqNullSafe(F.col("_day")) & F.col(visitor).eqNullSafe(F.col("_visitor")), "left")
        admitted = ranked.select(*key, order, (F.col("_place") + F.coalesce("_before", F.lit(0)) <= per_visitor).alias("admitted"))
        admitted = admitted.unionByName(rows.where(~named).withColumn("admitted", F.lit(True)))
        admitted = of_the_site(spark, admitted, number) if per_day is not None else admitted.withColumn("reason", F.when(~F.col("admitted"), "visitor"))
        admitted.write.mode("overwrite").parquet(f"{folder}/admitted/batch={number:010d}")
        own = rows.where(named).select(*key, F.lit(1).cast("long").alias("_n"))
        own.unionByName(known).groupBy(*key).agg(F.sum("_n").alias("_n")).write.mode("overwrite").parquet(f"{counts}/batch={number}")
        # the batch before may be run again after a failure, those before that no more
        delete(spark, f"{counts}/batch={number - 2}")

    def of_the_site(spark: SparkSession, rows: DataFrame, number: int) -> DataFrame:
        # the search that fills a day is found among its first ones: tasks keep no more of a day than that
        rows = staged(rows, "candidates")
        known = spark.read.schema(days).parquet(f"{folder}/days/batch={number - 1}")
        used = known.select(F.col(day).alias("_day"), F.col("_n").alias("_used"))
        first = rows.where("admitted").withColumn("_nth", F.row_number().over(Window.partitionBy(day).orderBy(order))).where(F.col("_nth") <= per_day)
        first = first.join(used, F.col(day).eqNullSafe(F.col("_day")), "left").withColumn("_left", F.greatest(F.lit(0), per_day - F.coalesce("_used", F.lit(0))))
        fills = staged(first.where("_nth <= _left").groupBy(day).agg(F.max(order).alias("_last"), F.count("*").alias("_n"), F.max("_left").alias("_left")), "days")
        fills.select(day, "_n").unionByName(known).groupBy(day).agg(F.sum("_n").alias("_n")).write.mode("overwrite").parquet(f"{folder}/days/batch={number}")
        delete(spark, f"{folder}/days/batch={number - 2}")
        # a day is full from the search on that used up what was left of it
        end = fills.select(F.col(day).alias("_day"), "_last", (F.col("_n") >= F.col("_left")).alias("_fills"))
        end = end.join(used.select(F.col("_day").alias("_other"), "_used"), F.col("_day").eqNullSafe(F.col("_other")), "full")
        end = end.select(F.coalesce("_day", "_other").alias("_day"), "_last", "_fills", (F.coalesce("_used", F.lit(0)) >= per_day).alias("_full"))
        both = rows.join(end, F.col(day).eqNullSafe(F.col("_day")), "left")
        site = F.coalesce(F.col("_full"), F.lit(False)) | F.coalesce(F.col("_fills") & (F.col(order) > F.col("_last")), F.lit(False))
        reason = F.when(site, "site").when(~F.col("admitted"), "visitor")
        return both.withColumn("reason", reason).withColumn("admitted", F.col("admitted") & ~site).select(*key, order, "admitted", "reason")

    return searches.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")


def capped_once(searches: DataFrame, per_visitor: int, day: str = "day", visitor: str = "visitor", order: str = "ord", per_day: int | None = None) -> DataFrame:
    """capped_to for all that is there, and a read of what it wrote."""
    spark = searches.sparkSession
    folder = new_folder(spark, "capped")
    capped_to(searches, folder, per_visitor, day, visitor, order, per_day).trigger(availableNow=True).start().awaitTermination()
    kinds = dict(searches.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (day, visitor, order)) + ", admitted boolean, reason string"
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/admitted/batch=-1")
    return spark.read.schema(schema).parquet(f"{folder}/admitted").drop("batch")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there, through the stream into Parquet in the shared folder; nothing passes through
    the driver.  In the mode complete the last result stays."""
    folder = new_folder(stream.sparkSession, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number:010d}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    if mode != "complete":
        stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{folder}/rows/batch=-1")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
