"""Exact deduplication by a tree-merge of sorted digest runs.

Every scan partition makes one run: its documents' digests, sorted, one row for each distinct text.
Runs are then merged in rounds, `fan_in` at a time, as in a binomial tree of that order: in round k the
runs whose numbers agree after dropping k digits (base `fan_in`) meet. A run is cut into buckets by its
digests, so that a merge is shared by many tasks and no task ever holds a whole run; within a task the
pieces come sorted and are merged as a stream, holding one row. At every level a row keeps the best
identifier of its text and the number of documents behind it.

A digest is verified at every level: SHA-256, a second independent 64-bit hash and the length must all
agree, or the rows stay apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import hot_join, materialize, shuffle_partitions, ship

KEY = ["digest", "check_hash", "norm_chars"]
_RUN = "run long, bucket int, digest binary, check_hash long, norm_chars int, n_chars int, doc_id long, size long"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and the verified digest of the text without white space."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), F.unhex(F.sha2(norm, 256)).alias("digest"), F.xxhash64(norm).alias("check_hash"), F.length(norm).alias("norm_chars"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch of sorted rows that agree in run, bucket and key, the first, with the sum of sizes."""
    held = None
    for batch in batches:
        rows = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
        rows = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows, dtype=bool)
        new[0] = True
        for name in ("run", "bucket", *KEY):
            column = rows.column(name)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        sizes = np.add.reduceat(rows.column("size").to_numpy(), first)
        merged = rows.take(pa.array(first))
        merged = merged.drop_columns("size").append_column("size", pa.array(sizes, pa.int64()))
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield from held.combine_chunks().to_batches()


def _sorted_merge(rows: DataFrame) -> DataFrame:
    """The longest original text comes first, then the smallest id (null last)."""
    order = ["run", "bucket", *KEY, F.desc("n_chars"), F.asc_nulls_last("doc_id")]
    return rows.sortWithinPartitions(*order).mapInArrow(_merge, _RUN)


def tree_merge(found: DataFrame, fan_in: int = 16) -> DataFrame:
    """One row for each distinct text: its key, keep_id and group_size."""
    n = shuffle_partitions(found.sparkSession)
    names = [x.split()[0] for x in _RUN.split(", ")]
    runs = found.withColumns({"run": F.spark_partition_id().cast("long"), "bucket": F.pmod("check_hash", F.lit(n)).cast("int"), "size": F.lit(1).cast("long")}).select(*names)
    left = found.rdd.getNumPartitions()
    runs = _sorted_merge(runs)
    while left > 1:
        runs = _sorted_merge(runs.withColumn("run", F.floor(F.col("run") / fan_in)).repartition(n, "bucket", "run"))
        left = -(-left // fan_in)
    return runs.select(*KEY, F.col("doc_id").alias("keep_id"), F.col("size").alias("group_size"))


def exact_dedup(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text).

    A null text counts as empty; all empty or blank texts are equal. Rows that repeat the doc_id that
    stays are kept too. A null id stays only where no row as long has one. An empty table gives none; other
    columns don't matter, whatever their names.
    """
    ship(docs.sparkSession)
    found = materialize(digests(docs))
    groups = materialize(tree_merge(found, fan_in))
    joined = hot_join(found, groups, KEY, "group_size", found.count())
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
