"""Hard negatives of anchors, by bounds along spanning trees of anchors.

The anchors come in blocks of a fixed size, so what is broadcast has a bound; each block passes twice over
all rows. Within a block, anchors of one label that lie close together form trees of at most TREE, each the
least spanning tree of its anchors. In a batch of rows the root's scores are computed. At a child, a row's
score differs from that at the parent by at most the edge's length times the row's norm, so only rows whose
interval meets the child's window are scored again; for the others the interval goes on to the next level.

First pass: rows of the anchor's label, with a window that begins at the worst of the best scores so far;
its result are the positives. Second pass: rows of other labels, whose windows reach from four fifths of a
positive's score to that score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.common import materialize, release, ship
from pairwright.functions.scratch import scratch
from pairwright.llm.vectors import exact_type, matrix, padded, usable, whole_components

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
#: Anchors of a block, anchors of a tree, and rows that a tree meets at once.
BLOCK, TREE, _ROWS = 16_384, 512, 4096
#: Percent of the positive's score from which on a row is a hard negative.
LEAST = 80


@dataclass(frozen=True)
class Tree:
    """Anchors of one label, parents before children; the root's parent is -1."""

    label: object
    anchors: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray


def _parted(vectors: np.ndarray, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """rows in groups of at most `most`, halved where they differ most."""
    if len(rows) <= most:
        yield rows
        return
    x = vectors[rows]
    by = rows[np.argsort(x[:, x.var(axis=0).argmax()] if x.shape[1] else np.zeros(len(x)), kind="stable")]
    for half in (by[: len(by) // 2], by[len(by) // 2 :]):
        yield from _parted(vectors, half, most)


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parents (places in that order) and edge lengths, rounded up, of a least spanning tree from the middle."""
    x = vectors.astype(np.float64)
    n = len(x)
    root = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order, parent, edge, place = [root], [-1], [0.0], np.zeros(n, np.int64)
    near = ((x - x[root]) ** 2).sum(axis=1)
    by = np.full(n, root)
    near[root] = np.inf
    for _ in range(n - 1):
        i = int(near.argmin())
        place[i] = len(order)
        order.append(i)
        parent.append(int(place[by[i]]))
        edge.append(math.sqrt(near[i]) * (1 + 1e-9))
        d = ((x - x[i]) ** 2).sum(axis=1)
        closer = d < near
        closer[order] = False
        near[closer], by[closer] = d[closer], i
        near[i] = np.inf
    return np.array(order), np.array(parent), np.array(edge)


def plant(vectors: np.ndarray, labels: list, most: int = TREE) -> list[Tree]:
    """Trees over all anchors of a block."""
    of: dict[object, list[int]] = {}
    for i, label in enumerate(labels):
        of.setdefault(label, []).append(i)
    out = []
    for label, rows in of.items():
        for group in _parted(vectors, np.array(rows), most):
            order, parent, edge = spanning_tree(vectors[group])
            out.append(Tree(label, group[order], vectors[group[order]], parent, edge))
    return out


def climb(tree: Tree, x: np.ndarray, norms: np.ndarray, window) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each anchor of the tree: the rows of x that may score within window(anchor), and their exact scores.

    window gives least and greatest score, or None where nothing is wanted; it is asked when the anchor's turn comes.
    """
    left = np.bincount(tree.parent[1:], minlength=len(tree.anchors))
    middle: list[np.ndarray | None] = []
    spread: list[np.ndarray | None] = []
    for i, (anchor, p) in enumerate(zip(tree.anchors.tolist(), tree.parent.tolist(), strict=True)):
        want = window(anchor)
        if p < 0:
            m, s = x @ tree.vectors[i], np.zeros(len(x))
        else:
            m, s = middle[p], spread[p] + tree.edge[i] * norms
            left[p] -= 1
            if not left[p]:
                middle[p] = spread[p] = None
        if want is None:
            rows = np.zeros(0, np.int64)
        else:
            slack = 1 + 1e-9 * (np.abs(m) + s)
            rows = np.flatnonzero((m + s + slack >= want[0]) & (m - s - slack <= want[1]))
        if p >= 0 and len(rows):
            m = m.copy()
            m[rows], s[rows] = x[rows] @ tree.vectors[i], 0
        keep = left[i] > 0
        middle.append(m if keep else None)
        spread.append(s if keep else None)
        if len(rows):
            yield anchor, rows, m[rows].astype(np.int64)


#: Score, smaller first, and vec_id, null last: the order of the contract.
_Entry = tuple[int, bool, int]


def _entries(scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> list[_Entry]:
    return [(-s, z, i) for s, z, i in zip(scores.tolist(), nulls.tolist(), ids.tolist(), strict=True)]


@dataclass(frozen=True)
class _Pass:
    """One pass over the rows: trees, and for the second one each anchor's positives, best first."""

    trees: list[Tree]
    width: int
    kind: type
    keep: int
    positives: list[list[tuple[int, int | None]]] | None


def _batches(batches: Iterator[pa.RecordBatch], width: int, kind: type):
    """Labels, ids, nulls among them, vectors and norms, in stretches of rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            b = batch.slice(start, _ROWS)
            x = matrix(b.column(2), width).astype(kind)
            real = x.astype(np.float64)
            nulls = np.asarray(b.column(0).is_null())
            yield b.column(1).to_numpy(zero_copy_only=False), b.column(0).fill_null(0).to_numpy(zero_copy_only=False), nulls, x, np.sqrt((real * real).sum(axis=1)) * (1 + 1e-9)


def _best_of_label(shared):
    """anchor, vec_id and score of the task's best rows of every anchor's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        best: dict[int, list[_Entry]] = {}

        def window(anchor: int) -> tuple[float, float]:
            held = best.get(anchor, ())
            return (-held[-1][0] if len(held) == p.keep else -math.inf), math.inf

        for labels, ids, nulls, x, norms in _batches(batches, p.width, p.kind):
            for tree in p.trees:
                own = np.flatnonzero(labels == tree.label)
                for anchor, rows, scores in climb(tree, x[own], norms[own], window) if len(own) else ():
                    top = np.argsort(-scores, kind="stable")
                    if len(top) > p.keep:  # all that tie with the last one
                        top = np.flatnonzero(scores >= scores[top[p.keep - 1]])
                    at = own[rows[top]]
                    best[anchor] = sorted([*best.get(anchor, ()), *_entries(scores[top], ids[at], nulls[at])])[: p.keep]
        rows = [(a, None if z else i, -s) for a, held in best.items() for s, z, i in held]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), ()))], names=["anchor", "vec_id", "score"])

    return run


def _bounds(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative: LEAST * positive <= 100 * score <= 100 * positive."""
    return -(-LEAST * positive // 100), positive


def _hardest(shared):
    """anchor, place of the positive, vec_id and score of the task's first rows of other labels in each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        windows = [[(j, *_bounds(score)) for j, (score, _) in enumerate(found)] for found in p.positives]
        windows = [[w for w in each if w[1] <= w[2]] for each in windows]
        best: dict[tuple[int, int], list[_Entry]] = {}

        def window(anchor: int) -> tuple[float, float] | None:
            lows = []
            for j, low, _ in windows[anchor]:
                held = best.get((anchor, j), ())
                lows.append(-held[-1][0] if len(held) == p.keep else low)
            return (min(lows), max(w[2] for w in windows[anchor])) if lows else None

        for labels, ids, nulls, x, norms in _batches(batches, p.width, p.kind):
            for tree in p.trees:
                other = np.flatnonzero(labels != tree.label)
                for anchor, rows, scores in climb(tree, x[other], norms[other], window) if len(other) else ():
                    low, high = window(anchor)
                    fit = (scores >= low) & (scores <= high)
                    if not fit.any():
                        continue
                    at, scores = other[rows[fit]], scores[fit]
                    by = np.lexsort((ids[at], nulls[at], -scores))
                    at, falling = at[by], -scores[by]
                    for j, low, high in windows[anchor]:
                        first = int(np.searchsorted(falling, -high))
                        last = min(first + p.keep, int(np.searchsorted(falling, -low, "right")))
                        if first < last:
                            some = at[first:last]
                            best[anchor, j] = sorted([*best.get((anchor, j), ()), *_entries(-falling[first:last], ids[some], nulls[some])])[: p.keep]
        rows = [(a, j, None if z else i, -s) for (a, j), held in best.items() for s, z, i in held]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((), (), (), ()))], names=["anchor", "positive", "vec_id", "score"])

    return run


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of every key, with their rank; a row for each task and anchor at most k times."""
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _positives(anchors: list, found: list) -> list[list[tuple[int, int | None]]]:
    """score and id of each anchor's first rows but itself, in order: of the rows alike in id and score one is the anchor."""
    held: list[list[tuple[int, int | None]]] = [[] for _ in anchors]
    for r in sorted(found, key=lambda r: (r["anchor"], r["rank"])):
        held[r["anchor"]].append((r["score"], r["vec_id"]))
    for each, a in zip(held, anchors, strict=True):
        own = (sum(v * v for v in a["vector"]), a["vec_id"])
        if own in each:
            each.remove(own)
        del each[POSITIVES:]
    return held


def prepared(vectors: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int, int]:
    """vec_id, label (shifted where vec_id is divisible by 7) and whole-number vector of the rows that take part; width and largest component."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.filter(F.col("label").isNotNull() & usable(F.col("embedding")))
    return padded(rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole_components(F.col("embedding"), scale).alias("vector")), "vector")


def hard_negatives(vectors: DataFrame, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for anchors, the rows whose vec_id is divisible by `every`.

    Rows with a null label, a null vector, or null or non-finite components take no part. A null vec_id is
    no anchor, keeps its label, and comes last among equal scores. Repeated rows count each: a copy of an
    anchor is an anchor itself and a positive of the other. An anchor without positives, and a positive
    whose score is negative, have no rows. Shorter vectors count as padded with zeros, components beyond
    2**27 after scaling as 2**27. Other columns are not carried on.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows, width, largest = prepared(vectors)
    rows = materialize(rows)
    kind = exact_type(width, largest)
    anchors = rows.filter(F.col("vec_id") % every == 0)
    blocks = max(1, math.ceil(anchors.count() / block))
    path = scratch(spark)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], result).write.parquet(path)
    for k in range(blocks):
        mine = anchors if blocks == 1 else anchors.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == k)
        own = sorted(mine.collect())
        if not own:
            continue
        trees = plant(np.array([a["vector"] for a in own], kind).reshape(len(own), width), [a["label"] for a in own])
        shared = spark.sparkContext.broadcast(_Pass(trees, width, kind, POSITIVES + 1, None))
        best = _first(rows.mapInArrow(_best_of_label(shared), "anchor long, vec_id long, score long"), ["anchor"], POSITIVES + 1)
        positives = _positives(own, best.collect())  # six rows for each anchor of the block
        shared = spark.sparkContext.broadcast(_Pass(trees, width, kind, NEGATIVES, positives))
        found = _first(rows.mapInArrow(_hardest(shared), "anchor long, positive long, vec_id long, score long"), ["anchor", "positive"], NEGATIVES)
        named = [(i, j, own[i]["vec_id"], p, s) for i, each in enumerate(positives) for j, (s, p) in enumerate(each)]
        names = spark.createDataFrame(named, "anchor long, positive long, anchor_id long, positive_id long, positive_score long")
        out = found.join(names, ["anchor", "positive"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    release(rows)
    return spark.read.schema(result).parquet(path)
