"""Sends the package to Python workers, for sessions whose executors don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_pairwright_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="pairwright-")) / "pairwright.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, str(path.relative_to(_ROOT.parent)))
    sc.addPyFile(str(archive))
    sc._pairwright_shipped = True
