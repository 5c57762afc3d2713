"""Views over the given tables in the shape of the engine's inputs; every value comes by integer arithmetic.

No table has coordinates, titles or places of its own. `*_SQL` are the same views for the SQL counterparts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTRIES = ["US", "QA", "US", "AE", "US", "SA", "US", "KW", "US", "BH"]
TODAY = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys in many partitions, however few bytes they are, for work that is long for each row."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as side a and customers as side b, on a plane of some 550 by 800 miles."""

    def side(name: str, key: str, nation: str, balance: str, side: str) -> DataFrame:
        k = F.col(key)
        score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor((F.col(balance) + 1000) / 110))).cast("long")
        remote = (k % 50 == 7) if side == "b" else F.lit(False)
        return table(spark, sf_dir, name).select(
            F.concat(F.lit("S" if side == "a" else "C"), k.cast("string")).alias("id"), F.lit(side).alias("side"), F.concat(F.lit("Org "), (k % 37).cast("string")).alias("org"), score.alias("score"),
            (39 + ((k * 7919) % 800) / 100.0).alias("lat"), (-90 + ((k * 104729) % 1600) / 100.0).alias("lon"), pick(COUNTRIES, F.col(nation) % 10).alias("country"),
            F.concat(F.lit("R"), (k % 5).cast("string")).alias("region"), F.concat(F.lit("City "), (k % 97).cast("string")).alias("city"), ((k * 31) % 1000003).alias("population"),
            F.when(k % 10 == 0, "region").otherwise("city").alias("precision"), F.when(remote, "remote").otherwise("onsite").alias("work_model"), (k * 2 + (0 if side == "a" else 1)).alias("ordinal"),
        )

    return side("supplier", "s_suppkey", "s_nationkey", "s_acctbal", "a").unionByName(side("customer", "c_custkey", "c_nationkey", "c_acctbal", "b"))


def _site_sql(name: str, key: str, nation: str, balance: str, side: str) -> str:
    remote = f"CASE WHEN {key} % 50 = 7 THEN 'remote' ELSE 'onsite' END" if side == "b" else "'onsite'"
    return f"""SELECT '{"S" if side == "a" else "C"}' || {key} AS id, '{side}' AS side, 'Org ' || ({key} % 37) AS org,
      greatest(0, least(100, floor(({balance} + 1000) / 110)))::BIGINT AS score, 39 + (({key} * 7919) % 800) / 100.0::DOUBLE AS lat, -90 + (({key} * 104729) % 1600) / 100.0::DOUBLE AS lon,
      ({sql_list(COUNTRIES)})[{nation} % 10 + 1] AS country, 'R' || ({key} % 5) AS region, 'City ' || ({key} % 97) AS city, ({key} * 31) % 1000003 AS population,
      CASE WHEN {key} % 10 = 0 THEN 'region' ELSE 'city' END AS "precision", {remote} AS work_model, {key} * 2 + {0 if side == "a" else 1} AS ordinal FROM {name}"""


SITES_SQL = f"sites AS ({_site_sql('supplier', 's_suppkey', 's_nationkey', 's_acctbal', 'a')} UNION ALL {_site_sql('customer', 'c_custkey', 'c_nationkey', 'c_acctbal', 'b')})"

TITLES = [
    "Vascular Surgeon", "Diagnostic Radiologist - Cleveland, OH", "Interventional Radiologist IR/DR", "Radiology Technologist", "Medical Assistant, Vascular Surgery", "Orthopedic Spine Surgeon",
    "Attending Physician", "Remote Teleradiologist", "Hybrid Role Breast Imaging Radiologist", "On-site Neuroradiologist", "Vascular and Endovascular Surgery Faculty, Chief", "Consultant",
    "Irving Radiology Associates: General Radiologist (Doha, Qatar)", "Locum Vascular Surgeon", "Cardiothoracic & Vascular Anesthesiologist", "Body Imaging Fellow",
]
ORGS = ["", "Lakeside Vascular Group", "State University School of Medicine", "VA Medical Center", "North Health System Inc", "Bay Radiology Partners LLC", "Mercy Hospital", "Source 3"]
PLACES = [
    "Cleveland, OH", "Springfield, IL", "Springfield, MO", "Doha, Qatar", "Remote", "Remote - Akron, Ohio", "Al Khobar, Saudi Arabia", "Texas", "Qatar", "St. Louis, MO", "Multiple Locations",
    "Smalltown, OH", "Akron, OH; Cleveland, OH", "", "Springfield", "Kuwait City",
]
BODIES = [
    "Busy practice with open and endovascular cases, aortic work and limb salvage. Hybrid OR available. Level I trauma center.",
    "General diagnostic radiology, body imaging, no call, 10 weeks vacation, partnership track, home workstation.",
    "Join our radiologist team and vascular surgeon colleagues. Must cover pediatric call. Entry-level welcome.",
    "Location: Akron, Ohio. Fully remote position. Nationally ranked hospital. Solo coverage, q2 call.",
    "Academic faculty with research at a university. Hybrid schedule. Dialysis access and venous work.",
    "", "Great team in Cleveland, OH near the lake. Favorable call.", "Vascular surgery program at a veterans health facility with vascular surgeon leadership. J-1 only. " + "More detail. " * 30,
]
CATEGORIES = ["health-system", "society-board", "aggregator", "specialty-group", "teleradiology"]


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings from five sources."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(pick(TITLES, k % 16), F.when(k % 16 == 1, F.lit("")).otherwise(F.concat(F.lit(" "), (c % 50).cast("string")))).alias("title"), pick(ORGS, c % 8).alias("org"), pick(PLACES, F.floor(c / 8) % 16).alias("location"),
        pick(BODIES, F.floor(k / 16) % 8).alias("description"), F.concat(F.lit("https://jobs.example/"), k.cast("string")).alias("url"),
        F.when(k % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date_posted"), F.lit("").alias("department"), F.concat(F.lit("Source "), (k % 5).cast("string")).alias("source_name"),
        pick(CATEGORIES, k % 5).alias("category"), (k % 5).cast("int").alias("source_ordinal"), k.alias("posting_ordinal"),
    )


POSTINGS_SQL = f"""postings AS (
  SELECT ({sql_list(TITLES)})[o_orderkey % 16 + 1] || CASE WHEN o_orderkey % 16 = 1 THEN '' ELSE ' ' || (o_custkey % 50) END AS title, ({sql_list(ORGS)})[o_custkey % 8 + 1] AS org,
    ({sql_list(PLACES)})[(o_custkey // 8) % 16 + 1] AS location, ({sql_list(BODIES)})[(o_orderkey // 16) % 8 + 1] AS description, 'https://jobs.example/' || o_orderkey AS url,
    CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_posted, '' AS department, 'Source ' || (o_orderkey % 5) AS source_name,
    ({sql_list(CATEGORIES)})[o_orderkey % 5 + 1] AS category, (o_orderkey % 5)::INT AS source_ordinal, o_orderkey AS posting_ordinal FROM orders)"""
