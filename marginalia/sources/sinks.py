"""Sinks: corpora, reports, logs, manifests and their check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import digest_sums


def write_corpus(records: DataFrame, path: str, form: str = "parquet") -> None:
    records.write.mode("overwrite").format(form).save(path)


def write_verified(records: DataFrame, matches: DataFrame, stats: DataFrame, folder: str) -> None:
    """The verified corpus and the report of the cross-check.  matches should be a written table, as
    plans.build.cross_checked gives it: then all three come from one computation of it."""
    records.write.mode("overwrite").parquet(f"{folder}/records")
    matches.write.mode("overwrite").parquet(f"{folder}/matches")
    stats.write.mode("overwrite").json(f"{folder}/stats")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def table_digest(rows: DataFrame, *columns: str) -> DataFrame:
    """rows, bytes and a digest of a table that doesn't depend on the order of its rows: sums over the digests
    of rows, which are partial aggregates in every task."""
    row = F.to_json(F.struct(*(columns or sorted(rows.columns))))
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length(row)), F.lit(0)).alias("n_bytes"), F.sha2(F.concat_ws("-", *digest_sums(F.sha2(row, 256))), 256).alias("digest"))


def manifest(spark: SparkSession, model: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each table: name, model, n_rows, n_bytes, digest."""
    found = None
    for name, rows in tables.items():
        one = table_digest(rows).select(F.lit(name).alias("name"), F.lit(model).alias("model"), "n_rows", "n_bytes", "digest")
        found = one if found is None else found.unionByName(one)
    return found


def check_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """The names whose table is missing or differs in rows, bytes or digest."""
    kept = ("n_rows", "n_bytes", "digest")
    both = expected.select("name", F.struct(*kept).alias("expected")).join(found.select("name", F.struct(*kept).alias("found")), "name", "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))


def storage_status(table: DataFrame, pending: DataFrame, saved: str, durable: bool = True, error: str | None = None) -> DataFrame:
    """One row on a stored log: durable, rows, pending (not yet stored), the last time it was saved, error."""
    counts = table.agg(F.count("*").alias("rows"), F.max(saved).alias("last_save")).crossJoin(pending.agg(F.count("*").alias("pending")))  # one row each
    return counts.select(F.lit(durable).alias("durable"), "rows", "pending", "last_save", F.lit(error).cast("string").alias("error"))


def storage_summary(status: DataFrame) -> DataFrame:
    """What of a status is shown to the public: healthy (durable and without error), rows, pending, last_save."""
    return status.select((F.col("durable") & F.col("error").isNull()).alias("healthy"), "rows", "pending", "last_save")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes and SHA-256 of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
