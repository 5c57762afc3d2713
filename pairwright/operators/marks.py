"""A table of marks, one row for each board and role, merged by copy on write.

Rows lie in buckets by board. A merge writes only the buckets that it touches, under the number of the new
version, and then a manifest that says which version each bucket is read from. Readers take the manifest
with the largest number, so they see a merge whole or not at all; a merge that dies leaves files that no
manifest names, and the next one writes over them. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.operators.board import mark_error

BUCKETS = 64
_COLUMNS = "board_id string, role_id string, pinned boolean, status string, note string, by string, updated_at timestamp, seq long"
_MANIFEST = "bucket int, version long"


def _missing(error: Exception) -> bool:
    return getattr(error, "getCondition", lambda: "")() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def versions(spark: SparkSession, path: str) -> dict[int, int]:
    """The version of each bucket that has rows, by the last manifest; under -1 that manifest's own number."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(f"{_MANIFEST}, number long").parquet(f"{path}/manifest")
        last = rows.filter(F.col("number") == rows.agg(F.max("number")).first()[0]).collect()
    except AnalysisException as e:
        if not _missing(e):
            raise
        return {}
    return {r["bucket"]: r["version"] for r in last} | ({-1: last[0]["number"]} if last else {})


def bucket_of(board_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(board_id), F.lit(buckets)).cast("int")


def read_marks(spark: SparkSession, path: str, boards: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The marks of all boards, or of some, for which only their buckets are read."""
    found = {b: v for b, v in versions(spark, path).items() if b >= 0}
    if boards is not None:
        own = {r[0] for r in spark.createDataFrame([(b,) for b in boards], "b string").select(bucket_of(F.col("b"), buckets)).collect()}
        found = {b: v for b, v in found.items() if b in own}
    if not found:
        return spark.createDataFrame([], _COLUMNS)
    rows = spark.read.schema(_COLUMNS).parquet(*(f"{path}/data/version={v}/bucket={b}" for b, v in sorted(found.items())))
    return rows if boards is None else rows.filter(F.col("board_id").isin(*boards))


def merge_marks(spark: SparkSession, path: str, marks: DataFrame, now: Column | None = None, buckets: int = BUCKETS) -> list[int]:
    """Puts the valid rows of marks in place of older ones of their board and role; the buckets that were written.

    now stamps all rows; without it they have their own updated_at. seq, where marks have one, orders rows of
    one instant, otherwise their own order does; rows of the table that are newer stay.
    """
    stamped = marks.filter(mark_error().isNull())
    stamped = stamped.withColumn("updated_at", (F.col("updated_at") if now is None else now).cast("timestamp"))
    stamped = stamped.withColumn("seq", F.col("seq").cast("long") if "seq" in marks.columns else F.monotonically_increasing_id())
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    fresh = stamped.select(*names).withColumn("bucket", bucket_of(F.col("board_id"), buckets))
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # BUCKETS at most
    if not touched:
        return []
    was = versions(spark, path)
    number = was.pop(-1, 0) + 1
    old = [f"{path}/data/version={was[b]}/bucket={b}" for b in touched if b in was]
    both = fresh
    if old:
        both = fresh.unionByName(spark.read.schema(_COLUMNS).parquet(*old).withColumn("bucket", bucket_of(F.col("board_id"), buckets)))
    last = W.partitionBy("board_id", "role_id").orderBy(F.desc("updated_at"), F.desc("seq"))
    kept = both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={number}")
    _publish(spark, path, number, {**was, **dict.fromkeys(touched, number)})
    return touched


def _publish(spark: SparkSession, path: str, number: int, found: dict[int, int]) -> None:
    spark.createDataFrame(sorted(found.items()), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/number={number}")
