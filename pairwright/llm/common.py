"""What several operators need: shared scratch tables, joins that stand hot keys, and slices of batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions.scratch import materialize, release
from pairwright.functions.ship import ship

__all__ = ["PARTS", "columns_of", "held_out", "hot_join", "map_columns", "materialize", "release", "ship", "shuffle_partitions", "slices", "table"]

#: A hot group is dealt out in pieces of a thousandth of all rows each, so there are at most PARTS hot groups.
PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with one row for each group; `size` counts a group's rows, `total` all of them.

    The rows of a hot group, one of more than a thousandth of all rows, are dealt out in as many pieces as
    it has thousandths, and its row is repeated for each of them. Only the hot groups' hashes and numbers of
    pieces are told to all tasks, two numbers each for at most PARTS groups, whatever the keys and values weigh.
    """
    least = max(1000, total // PARTS)
    code = F.xxhash64(*keys)
    hot = groups.filter(F.col(size) > least).groupBy(code.alias("code")).agg(F.max(F.ceil(F.col(size) / least)).cast("long").alias("parts")).collect()
    parts = F.lit(1).cast("long")
    if hot:
        pieces = F.map_from_arrays(F.lit([r["code"] for r in hot]), F.lit([r["parts"] for r in hot]))
        parts = F.when(code.isin([r["code"] for r in hot]), F.element_at(pieces, code)).otherwise(parts)
    dealt = rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts))
    spread = groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(spread, [*keys, "_part"]).drop("_part")


def map_columns(df: DataFrame, run, more: list[T.StructField]) -> DataFrame:
    """df.mapInArrow(run) with `more` columns at its end; `run` sees columns c0, c1, ..., so that names may hold dots."""
    fields = [*df.schema.fields, *more]
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, plain).toDF(*(f.name for f in fields))


def slices(batches: Iterator[pa.RecordBatch], text_at: int = 0, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into stretches of rows whose texts hold about most_bytes, one row at least."""
    for b in batches:
        if not b.num_rows:
            yield b
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = before = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
            yield b.slice(at, end - at)
            before, at = int(upto[end - 1]), end
