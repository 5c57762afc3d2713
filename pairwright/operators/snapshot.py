"""What changes between runs: new roles, first sightings, roles carried over from failed sources, and reports.

Roles are kept as a table partitioned by run_date; `previous` is the latest run before today.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.text import gap_days

STALE_DAYS = 14
CARRIED = "carried over — its source was unreachable this run"


def write_snapshot(roles: DataFrame, path: str, run_date: str) -> None:
    """Replaces this run's partition only."""
    roles.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


def read_previous(spark: SparkSession, path: str, today: str, schema: T.StructType) -> DataFrame:
    """The latest snapshot before today, empty where there is none."""
    from pyspark.errors import AnalysisException

    try:
        runs = spark.read.parquet(path).filter(F.col("run_date") < F.lit(today).cast("date"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], T.StructType([*schema, T.StructField("run_date", T.DateType())]))
    last = runs.agg(F.max("run_date").alias("last"))
    return runs.join(F.broadcast(last), F.col("run_date") == F.col("last"), "left_semi")


def carry_forward(fresh: DataFrame, previous: DataFrame, failed_sources: DataFrame, today: Column) -> DataFrame:
    """Previous roles that are gone because their source failed, stale for STALE_DAYS at most."""
    gone = previous.join(fresh.select("id"), "id", "left_anti").join(failed_sources.select("source_name").distinct(), "source_name", "left_semi")
    since = F.when(F.coalesce("stale", F.lit(False)), F.coalesce("stale_since", today)).otherwise(today)
    gone = gone.withColumns({"stale_since": since, "stale": F.lit(True), "concerns": F.array_distinct(F.concat(F.coalesce("concerns", F.array().cast("array<string>")), F.array(F.lit(CARRIED))))})
    return gone.filter(gap_days(F.col("stale_since"), today) <= STALE_DAYS)


def with_first_seen(roles: DataFrame, previous: DataFrame, today: Column) -> DataFrame:
    """roles with is_new (never true without a previous run) and first_seen, which never changes."""
    known = previous.select("id", F.col("first_seen").alias("_seen"), F.coalesce("run_date", today).alias("_run"), F.lit(True).alias("_known"))
    some = previous.limit(1).agg((F.count("*") > 0).alias("_some"))
    df = roles.drop("first_seen", "is_new").join(known, "id", "left").crossJoin(F.broadcast(some))  # one row
    was = F.coalesce("_known", F.lit(False))
    return df.withColumns({"is_new": F.col("_some") & ~was, "first_seen": F.coalesce("_seen", F.when(was, F.col("_run")), today)}).drop("_seen", "_run", "_known", "_some")


def update_snapshot(fresh: DataFrame, previous: DataFrame, failed_sources: DataFrame, today: Column) -> DataFrame:
    """Fresh and carried roles with is_new and first_seen."""
    fresh = fresh.withColumns({"stale": F.lit(False), "stale_since": F.lit(None).cast("date")})
    carried = carry_forward(fresh, previous, failed_sources, today).drop("run_date", "first_seen", "is_new")
    return with_first_seen(fresh.unionByName(carried, allowMissingColumns=True), previous, today)


def run_counts(roles: DataFrame, funnel: DataFrame, pairs: DataFrame, areas: DataFrame, sources: DataFrame) -> DataFrame:
    """One row with the run's counters; funnel and pairs have one row each, pairs their number."""
    of_roles = roles.agg(F.count("*").alias("roles"), F.count_if(F.col("specialty") == "a").alias("a_roles"), F.count_if(F.col("specialty") == "b").alias("b_roles"), F.count_if("is_new").alias("new_roles"), F.count_if(F.coalesce("stale", F.lit(False))).alias("carried"))
    of_areas = areas.agg(F.count("*").alias("areas"), F.count_if("is_together").alias("together"))
    of_sources = sources.agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "failed").alias("sources_failed"))
    out = funnel.drop("roles")
    for one in (of_roles, pairs.select("pairs"), of_areas, of_sources):
        out = out.crossJoin(one)  # one row each
    return out


def source_coverage(sources: DataFrame, postings: DataFrame, statuses: DataFrame) -> DataFrame:
    """source_name, postings and status of every source: sweep-only, needs-credentials, failed, empty or ok.

    A source that needs credentials isn't failed; empty means that it gave no posting at all.
    """
    n = postings.groupBy("source_name").agg(F.count("*").alias("postings"))
    df = sources.join(statuses, "source_name", "left").join(n, "source_name", "left").withColumn("postings", F.coalesce("postings", F.lit(0)))
    status = F.when(~F.col("is_active"), "sweep-only").when(F.col("skipped").isNotNull(), "needs-credentials").when(F.col("error").isNotNull(), "failed").when(F.col("postings") == 0, "empty").otherwise("ok")
    return df.select("source_name", "postings", status.alias("status"))


def coverage_lists(coverage: DataFrame) -> DataFrame:
    """For each status but ok the names of its sources."""
    return coverage.filter("status <> 'ok'").groupBy("status").agg(F.array_sort(F.collect_list("source_name")).alias("sources"))
