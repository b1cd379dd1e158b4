"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of no more rows than this are broadcast; larger ones are joined by a shuffle.
FEW_ROWS = 500_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which the driver and all executors share; only in a local
    session without one it is a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what several parts of a plan read is worked out once,
    and it survives the loss of executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._marginalia_folder = folder
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of staged() that nothing reads any more: what was made of them is written as well."""
    for table in tables:
        delete(table.sparkSession, table._marginalia_folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, most: int = FEW_ROWS) -> bool:
    """Whether a table, best a written one, is small enough to be broadcast."""
    return df.limit(most + 1).count() <= most
