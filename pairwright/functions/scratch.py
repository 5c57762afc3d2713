"""Tables between jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/pairwright-checkpoints"  # one machine, as in tests


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder. What is written there goes when the application ends."""
    path = f"{_base(spark)}/pairwright-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder, which outlives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing will read again."""
    for t in tables:
        fs, at = _file_system(t.sparkSession, t._scratch_path)
        fs.delete(at, True)


def for_each_different(df: DataFrame, columns: list[str], find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that `find` adds to its different values of `columns`, each of which it is given once.

    Values meet again by SHA-256. The table of what was found is joined as Spark sees fit by its size: few
    different values are sent to the rows, many are met in a shuffle.
    """
    keyed = df.withColumn("_key", F.unhex(F.sha2(F.to_json(F.struct(*columns)), 256)))
    found = find(keyed.select("_key", *columns).distinct())
    return keyed.join(materialize(found.drop(*columns)), "_key").drop("_key")
