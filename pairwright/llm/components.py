"""Links that span components, found group by group, without all pairs and without the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.graph import components
from pairwright.llm.common import materialize, shuffle_partitions

#: Yields pairs of row numbers of a group's table that are linked, enough of them to span its components.
Linker = Callable[[pa.Table], Iterator[tuple[int, int]]]


def _stream(linker: Linker, keys: list[str]):
    """Runs the linker on each stretch of rows that agree in keys; holds one group."""

    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("doc").to_pylist()
        pairs = [(ids[i], ids[j]) for i, j in linker(table)]
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            rows = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
            marks = list(zip(*(rows.column(k).to_pylist() for k in keys), strict=True))
            start = 0
            for i, mark in enumerate(marks):
                if mark != last:
                    if last is not None:
                        held.append(rows.slice(start, i - start))
                        yield from links(pa.concat_tables(held).combine_chunks())
                        held = []
                    start, last = i, mark
            if len(marks) > start:
                held.append(rows.slice(start))
        if held:
            yield from links(pa.concat_tables(held).combine_chunks())

    return run


def _linked(rows: DataFrame, data: DataFrame, keys: list[str], linker: Linker) -> DataFrame:
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.join(data, "doc").repartition(n, *keys).sortWithinPartitions(*keys, "doc")
    return dealt.mapInArrow(_stream(linker, keys), "a long, b long")


def spanning_links(members: DataFrame, data: DataFrame, linker: Linker, block: int) -> DataFrame:
    """Links (a, b) that span the components of every group of members (g, doc), whatever its size.

    A group of more than `block` rows is dealt out in blocks, each with the group's leader, its smallest
    row. What the leader's component doesn't reach then, the minor rows, meet every block of the group.
    Of two unconnected rows one is minor, so no link between components is left out.
    """
    sizes = materialize(members.groupBy("g").agg(F.count("*").alias("n"), F.min("doc").alias("leader")))
    parts = F.ceil(F.col("n") / block).cast("long")
    mine = F.pmod(F.xxhash64("doc", "g"), parts)
    large = sizes.filter(F.col("n") > block)
    in_block = members.join(sizes, "g").select("g", "doc", mine.alias("part"))
    leaders = large.select("g", F.col("leader").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    edges = materialize(_linked(in_block.union(leaders).distinct(), data, ["g", "part"], linker))
    if not large.limit(1).count():
        return edges
    label = components(edges)
    named = lambda c: label.select(F.col("v").alias(c), F.col("c").alias(f"{c}_c"))
    of_large = members.join(large, "g").join(named("doc"), "doc", "left").join(named("leader"), "leader", "left")
    of_large = of_large.select("g", "doc", mine.alias("part"), (~F.coalesce("doc_c", "doc").eqNullSafe(F.coalesce("leader_c", "leader"))).alias("minor"), parts.alias("parts"))
    of_large = materialize(of_large)
    minors = of_large.filter("minor").groupBy("g").agg(F.ceil(F.count("*") / block).cast("long").alias("minor_parts"))
    minors = materialize(minors)
    if not minors.limit(1).count():
        return edges
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    met = of_large.join(minors, "g")
    every = met.select("g", "doc", "part", upto("minor_parts").alias("minor_part"))
    few = met.filter("minor").select("g", "doc", upto("parts").alias("part"), F.pmod(F.xxhash64("doc", "part"), F.col("minor_parts")).alias("minor_part"))
    return edges.union(materialize(_linked(every.union(few).distinct(), data, ["g", "part", "minor_part"], linker)))
