"""A small gazetteer for the fixture views; a real one comes from sources.geonames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "place_ordinal int, n string, r string, c string, lat double, lon double, p long, aliases array<string>"
PLACES = [
    ("Riyadh", "Riyadh", "SA", 24.6877, 46.7219, 4205961, []), ("Houston", "TX", "US", 29.7633, -95.3633, 2304580, []), ("Jeddah", "Mecca Region", "SA", 21.4901, 39.1862, 2867446, ["Jiddah"]),
    ("Kuwait City", "Al Asimah", "KW", 29.3697, 47.9783, 2989000, []), ("Doha", "Baladiyat ad Dawhah", "QA", 25.2855, 51.531, 344939, ["Ad Dawhah"]), ("Cleveland", "OH", "US", 41.4995, -81.6954, 372624, []),
    ("St. Louis", "MO", "US", 38.6273, -90.1979, 315685, []), ("Akron", "OH", "US", 41.0814, -81.519, 197542, []), ("Springfield", "MO", "US", 37.2153, -93.2982, 169176, []),
    ("Springfield", "IL", "US", 39.8017, -89.6437, 114394, []), ("Khobar", "Eastern Province", "SA", 26.2794, 50.2083, 165799, ["Al Khubar"]), ("Texas City", "TX", "US", 29.3838, -94.9027, 51898, []),
    ("Portland", "OR", "US", 45.5234, -122.6762, 652503, []),
]


def places(spark: SparkSession) -> DataFrame:
    rows = sorted(PLACES, key=lambda p: -p[5])
    return spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], SCHEMA)
