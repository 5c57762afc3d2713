"""The gazetteer out of GeoNames' tab-separated files: places, centroids, and places per country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.functions.geo import half_up
from pairwright.functions.scratch import materialize
from pairwright.operators.geocode import centroids

#: The countries that are kept, the least population in the first, and a place's most aliases.
COUNTRIES = ("US", "QA", "AE", "SA", "KW", "BH", "OM")
LEAST_POPULATION, MOST_ALIASES = 1000, 6
_CITY = "geonameid string, name string, ascii string, alternates string, lat double, lon double, class string, code string, country string, cc2 string, admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation string, dem string, timezone string, modified string"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def build_places(cities: DataFrame, admin1: DataFrame) -> DataFrame:
    """place_ordinal (most populous first), n, r, c, lat, lon, p and aliases.

    Regions are postal codes in the US and admin1 (code, label) names elsewhere, where places of any size
    stay and up to MOST_ALIASES ASCII aliases are kept.
    """
    us = F.col("country") == "US"
    df = cities.filter(F.col("country").isin(*COUNTRIES)).withColumn("p", F.coalesce("population", F.lit(0)))
    df = df.withColumn("n", F.coalesce(F.nullif("ascii", F.lit("")), F.nullif("name", F.lit("")))).filter(F.col("n").isNotNull() & (~us | (F.col("p") >= LEAST_POPULATION)))
    codes = F.broadcast(admin1.select(F.col("code").alias("_code"), F.col("label").alias("_label")))  # a row per first-level division of the world
    df = df.join(codes, F.concat_ws(".", "country", "admin1") == F.col("_code"), "left")
    other = F.filter(F.transform(F.split(F.coalesce("alternates", F.lit("")), ","), lambda a: F.trim(a)), lambda a: a.rlike(r"^[\x20-\x7E]+$") & (F.lower(a) != F.lower("n")))
    fourth = lambda c: half_up(F.col(c) * 1e4) / 1e4
    rows = df.select("n", F.when(us, F.col("admin1")).otherwise(F.coalesce("_label", F.lit(""))).alias("r"), F.col("country").alias("c"), fourth("lat").alias("lat"), fourth("lon").alias("lon"), "p", F.when(us, F.array().cast("array<string>")).otherwise(F.slice(other, 1, MOST_ALIASES)).alias("aliases"))
    return numbered(rows, [F.desc("p"), F.asc("n"), F.asc("c"), F.asc("r"), F.asc("lat"), F.asc("lon")], "place_ordinal")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in an order, from 0: sorted by ranges, numbered in each, from where the ranges before end."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    at = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_at", at).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_range", "_at", "_before")


def places_per_country(places: DataFrame) -> DataFrame:
    return places.groupBy("c").agg(F.count("*").alias("places"))


def write_gazetteer(places: DataFrame, path: str) -> None:
    places.write.mode("overwrite").parquet(f"{path}/places")
    centroids(places).write.mode("overwrite").parquet(f"{path}/centroids")
