"""Connected components of a graph that is a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.functions.scratch import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """v and c, the smallest vertex that it reaches, of every vertex of edges (a, b: long).

    Each round takes the least label among neighbours, then that label's own label, which halves paths.
    """
    both = edges.filter("a <> b").select("a", "b")
    e = materialize(both.union(both.select("b", "a")).distinct())
    labels = materialize(e.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("c")))
    while True:
        heard = e.join(labels.withColumnRenamed("v", "a"), "a").groupBy(F.col("b").alias("v")).agg(F.min("c").alias("m"))
        least = materialize(labels.join(heard, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c")))
        nearer = least.select(F.col("v").alias("c"), F.col("c").alias("n"))
        new = materialize(least.join(nearer, "c").select("v", "old", F.col("n").alias("c")))
        done = not new.filter("c <> old").limit(1).count()
        release(labels, least)
        if done:
            release(e)
            return new.select("v", "c")
        labels = new
