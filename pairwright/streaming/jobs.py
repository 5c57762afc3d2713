"""Structured Streaming forms of the incremental steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def incremental_harvest(spark: SparkSession, landing: str, schema: T.StructType | str, checkpoint: str, run: Callable[[DataFrame, int], None], source: str = "json") -> StreamingQuery:
    """Gives every new file of payloads to `run` once, a batch at a time, and stops when none is left."""
    files = spark.readStream.schema(schema).format(source).load(landing)
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def harvest_runs(spark: SparkSession, landing: str, checkpoint: str, path: str, sources: DataFrame, places: DataFrame, today: Callable[[int], str], source: str = "json", **options) -> StreamingQuery:
    """A run of the board for each batch of new payload files, under path. A batch that Spark hands out again is not applied twice."""
    from pairwright.operators.run import run_batch
    from pairwright.sources.payloads import SCHEMA

    def run(payloads: DataFrame, batch: int) -> None:
        run_batch(payloads.sparkSession, path, batch, sources, payloads, places, today(batch), **options)

    return incremental_harvest(spark, landing, SCHEMA, checkpoint, run, source)


def first_arrivals(stream: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark's delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def first_seen(stream: DataFrame, key: str, event_time: str) -> DataFrame:
    """key and the earliest event time so far; for update or complete output."""
    return stream.groupBy(key).agg(F.min(event_time).alias("first_seen"), F.count("*").alias("n"))


def counts_by_day(stream: DataFrame, event_time: str, delay: str) -> DataFrame:
    """Arrivals per day, final once the watermark has passed."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, "1 day").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "n")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now, into Parquet by append or into memory otherwise, and reads it."""
    spark = stream.sparkSession
    if mode == "append":
        path = f"{checkpoint}-out"
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    path = f"{checkpoint}-out"
    q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
