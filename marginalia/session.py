"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(name: str = "marginalia", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the package expects: UTC and adaptive execution."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}
    builder = SparkSession.builder.appName(name).master(f"local[{cores}]")
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors once for each context, for workers that don't find it on
    their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_marginalia_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="spark-")
    archive = os.path.join(folder, "marginalia.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(ROOT.rglob("*")):
            if path.suffix in (".py", ".json", ".txt") and "__pycache__" not in path.parts:
                z.write(path, Path("marginalia") / path.relative_to(ROOT))
    sc.addPyFile(archive)
    sc._marginalia_shipped = True
    return spark
