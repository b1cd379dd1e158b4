"""What the operators of this package share: reading, staging and small reductions."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.  Only
    where that is unset, as in local tests, a temporary folder takes its place."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_marginalia_folder", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        folder = spark._marginalia_folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: it cuts the lineage, it survives the
    loss of executors, and what follows reads it with a plain scan."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._marginalia_folder = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of staged() that nothing reads any more: what followed them is written as well."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._marginalia_folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and text, and more columns if named: other columns don't matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def added_blocks(df: DataFrame, length: int, parts: int, either: bool = False) -> np.ndarray:
    """The element-wise sum (or, with either, the union of bits) of long vectors that df holds in
    pieces: block int (0 to parts - 1) and sums binary (little-endian int64, length / parts of them).
    The pieces meet at their block's task, which keeps one running sum for each block; the driver gets
    `length` numbers."""
    join = np.bitwise_or if either else np.add

    def reduce(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(raw.as_buffer(), "<i8")
                sums[block] = join(part, sums[block]) if block in sums else part.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "sums"])

    total = np.zeros(length, np.int64)
    each = length // parts
    for row in df.repartition(parts, "block").mapInArrow(reduce, "block int, sums binary").collect():
        own = slice(row.block * each, (row.block + 1) * each)
        total[own] = join(total[own], np.frombuffer(row.sums, "<i8"))
    return total


def blocks_of(vector: np.ndarray, parts: int) -> pa.RecordBatch:
    """The pieces of a vector that added_blocks takes; all-zero ones are left out."""
    cut = [(i, v) for i, v in enumerate(np.split(vector.astype("<i8"), parts)) if v.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in cut], pa.int32()), pa.array([v.tobytes() for _, v in cut], pa.binary())], ["block", "sums"])


#: A table of at most so many rows is broadcast: with rows of a few short columns that is some tens of megabytes.
FEW_ROWS = 200_000


def few(df: DataFrame, most: int = FEW_ROWS) -> bool:
    """Whether a table, best a written one, is small enough to be broadcast."""
    return df.limit(most + 1).count() <= most


def looked_up(rows: DataFrame, known: DataFrame, keys: list[str], how: str = "inner", most: int = FEW_ROWS, least_hot: int = 10_000) -> DataFrame:
    """rows with the columns of the one row of `known` that has their keys (how: inner or left).

    A known table of few rows is broadcast.  A larger one is joined by a shuffle, but for the keys that have more than
    least_hot rows and a thousandth of all: their few known rows are broadcast, so no task gets all rows of such a key.  Both
    tables are read more than once, so they should be written ones."""
    if few(known, most):
        return rows.join(F.broadcast(known), keys, how)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = sizes.where(F.col("_n") > max(least_hot, rows.count() // 1000)).drop("_n")
    hot = staged(known.join(F.broadcast(hot), keys, "left_semi").withColumn("_hot", F.lit(True)), "hot")
    if hot.isEmpty():
        return rows.join(known, keys, how)
    marked = rows.join(F.broadcast(hot), keys, "left")
    cold = marked.where("_hot is null").select(*rows.columns).join(known, keys, how)
    return cold.unionByName(marked.where("_hot").drop("_hot"))
