"""The digest of a run: new roles of either side, best first, and the best areas with both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.functions.text import url_component

CAP, TOP_AREAS = 12, 5


def location_label() -> Column:
    """City with its state or country code, "Remote", or the text as it was."""
    tail = F.when(F.col("country") == "US", F.col("region")).otherwise(F.col("country"))
    return F.when(F.coalesce("city", F.lit("")) != "", F.concat_ws(", ", "city", tail)).when(F.col("work_model") == "remote", "Remote").otherwise(F.nullif("location_text", F.lit("")))


def digest_entries(roles: DataFrame, site_url: str, cap: int = CAP) -> DataFrame:
    w = W.partitionBy("specialty").orderBy(F.desc("score"), "id")
    top = roles.filter("is_new").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap)
    link = F.concat(F.lit(site_url.rstrip("/") + "/#role="), url_component(F.col("id")))
    return top.select("specialty", "rank", "id", "title", F.nullif("org", F.lit("")).alias("org"), location_label().alias("location"), "score", "setting", F.col("url").alias("posting_url"), link.alias("board_url"))


def digest_counts(roles: DataFrame) -> DataFrame:
    """One row of counts, which the cap doesn't touch."""
    new = F.col("is_new")
    return roles.agg(F.count("*").alias("total_roles"), F.count_if(new).alias("new_this_run"), F.count_if(new & (F.col("specialty") == "a")).alias("new_a"), F.count_if(new & (F.col("specialty") == "b")).alias("new_b"))


def digest_areas(areas: DataFrame, k: int = TOP_AREAS) -> DataFrame:
    return areas.filter("is_together").orderBy(F.desc("score"), "area_id").limit(k).select("area_id", "label", "score", "a_count", "b_count", "same_org")
