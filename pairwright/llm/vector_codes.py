"""Codes of vectors: parts assigned to the nearest of 256 entries, with Drake and Hamerly's adaptive bounds.

Every vector carries, for each of its parts, the entry it is assigned to with an upper bound of their
distance, its b next closest entries with lower bounds in order, and one bound for all the others. A round
moves the bounds by the entries' drifts. Where the upper bound stays below all lower ones nothing is
computed; otherwise the integer distance to the own entry decides, then those to the listed entries whose
bounds don't rule them out, and only if the outer bound fails too are all entries measured and listed anew.
b starts at a quarter of the entries and shrinks towards an eighth as rounds need shorter lists.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import hot_join, materialize, release, ship
from pairwright.llm.vectors import exact_type, matrix, padded, usable, whole_components

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to all entries are held at once.
_ROWS = 2048


def _layout(b: int) -> np.dtype:
    """What a part carries from round to round."""
    return np.dtype([("own", "u1"), ("upper", "f4"), ("listed", "u1", (b,)), ("lower", "f4", (b,)), ("outer", "f4")])


def _down(x: np.ndarray) -> np.ndarray:
    """As a 32-bit number that isn't larger."""
    y = x.astype(np.float32)
    return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float32(-np.inf)), y)


def _up(x: np.ndarray) -> np.ndarray:
    return -_down(-x)


def _roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distances below and above."""
    r = np.sqrt(squares.astype(np.float64))
    return r * (1 - 1e-12), r * (1 + 1e-12)


def _measure(x: np.ndarray, book: np.ndarray, kind: type) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    x, book = x.astype(kind), book.astype(kind)
    return ((x * x).sum(1)[:, None] + (book * book).sum(1) - 2 * (x @ book.T)).astype(np.int64)


def _anew(x: np.ndarray, book: np.ndarray, b: int, kind: type) -> np.ndarray:
    """State from all distances; the entry with the smallest index among the nearest."""
    far = _measure(x, book, kind)
    n, k = far.shape
    state = np.zeros(n, _layout(b))
    rows = np.arange(n)
    state["own"] = own = far.argmin(1)
    state["upper"] = _up(_roots(far[rows, own])[1])
    far[rows, own] = np.iinfo(np.int64).max
    by = np.argsort(far, axis=1, kind="stable")
    state["listed"] = by[:, :b]
    state["lower"] = _down(_roots(np.take_along_axis(far, by[:, :b], 1))[0])
    state["outer"] = _down(_roots(far[rows, by[:, b]])[0]) if b < k - 1 else np.inf
    return state


def _exact(x: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - book[entry]
    return np.einsum("ij,ij->i", d, d)


def _advance(x: np.ndarray, book: np.ndarray, drift: np.ndarray, state: np.ndarray, b: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """State after the entries moved, with b listed, and how many listed entries each row needed (b + 1: all entries)."""
    old = state["listed"].shape[1]
    upper = state["upper"].astype(np.float64) + drift[state["own"]]
    lower = state["lower"].astype(np.float64) - drift[state["listed"]]
    outer = state["outer"].astype(np.float64) - drift.max(initial=0)
    if b < old:
        outer = np.minimum(outer, lower[:, b:].min(1))
    out = np.zeros(len(state), _layout(b))
    own, listed, lower = state["own"].astype(np.int64), state["listed"][:, :b].astype(np.int64), lower[:, :b]
    rest = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], 1)[:, ::-1], 1)[:, ::-1]  # of this and all further entries
    depth = np.zeros(len(state), np.int64)
    open_ = np.flatnonzero(upper >= rest[:, 0])
    own_far = _exact(x[open_], book, own[open_])
    upper[open_] = _roots(own_far)[1]
    again = upper[open_] >= rest[open_, 0]
    open_, own_far = open_[again], own_far[again]
    depth[open_] = (rest[open_] <= upper[open_, None]).sum(1)
    full = open_[depth[open_] > b]
    some = depth[open_] <= b
    near, near_far = open_[some], own_far[some]
    if len(near):
        wide = int(depth[near].max())
        asked = np.arange(wide) < depth[near][:, None]
        far = np.full((len(near), wide + 1), np.iinfo(np.int64).max)
        far[:, 0] = near_far
        at, place = np.nonzero(asked)
        far[at, place + 1] = _exact(x[near[at]], book, listed[near[at], place])
        entry = np.concatenate([own[near, None], listed[near, :wide]], 1)
        # by distance, then index; those not asked keep their places behind
        by = np.lexsort((np.where(far < np.iinfo(np.int64).max, entry, np.arange(wide + 1)), far), axis=1)
        entry, far = np.take_along_axis(entry, by, 1), np.take_along_axis(far, by, 1)
        own[near], upper[near] = entry[:, 0], _roots(far[:, 0])[1]
        known = far[:, 1:] < np.iinfo(np.int64).max
        listed[near, :wide] = entry[:, 1:]
        lower[near, :wide] = np.where(known, _roots(far[:, 1:])[0], lower[near, :wide])
    out["own"], out["upper"], out["listed"], out["lower"], out["outer"] = own, _up(upper), listed, _down(lower), _down(outer)
    if len(full):
        out[full] = _anew(x[full], book, b, kind)
    return out, depth


@dataclass(frozen=True)
class _Round:
    """What a pass over the vectors needs; drift is None in the first one. old: entries listed so far."""

    books: np.ndarray
    drift: np.ndarray | None
    old: int
    b: int
    width: int
    kind: type


def _states(batch: pa.RecordBatch, r: _Round) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, their vectors, states and depths, in stretches."""
    vectors = matrix(batch.column(2), r.width).astype(np.int64)
    parts = len(r.books)
    for start in range(0, batch.num_rows, _ROWS):
        rows = slice(start, min(start + _ROWS, batch.num_rows))
        x = vectors[rows].reshape(-1, parts, r.width // parts)
        if r.drift is None:
            new = np.stack([_anew(x[:, p], r.books[p], r.b, r.kind) for p in range(parts)], 1)
            depth = np.full(new.shape, r.b + 1)
        else:
            held = np.frombuffer(b"".join(batch.column(3).slice(rows.start, rows.stop - rows.start).to_pylist()), _layout(r.old)).reshape(-1, parts)
            new, depth = map(lambda z: np.stack(z, 1), zip(*(_advance(x[:, p], r.books[p], r.drift[p], held[:, p], r.b, r.kind) for p in range(parts)), strict=True))
        yield rows, x, new, depth


def _assigner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            for rows, _, new, depth in _states(batch, r):
                own = [batch.column(c).slice(rows.start, rows.stop - rows.start) for c in range(3)]
                state = pa.array([s.tobytes() for s in new], pa.binary())
                codes = pa.array(list(new["own"].astype(np.int32)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*own, state, codes, pa.array(list(depth.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "label", "vector", "state", "code", "depth"])

    return run


def _encoder(shared):
    """Last pass: codes in hexadecimal and exact errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            for rows, x, new, _ in _states(batch, r):
                own = new["own"].astype(np.int64)
                error = sum(_exact(x[:, p], r.books[p], own[:, p]) for p in range(len(r.books)))
                codes = [c.tobytes().hex() for c in new["own"]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(rows.start, rows.stop - rows.start) for c in range(2)), pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _shorter(depths: list[tuple[int, int]], b: int, entries: int) -> int:
    """The list length of the next round: rows deeper than it pay for all entries, every row for keeping the list."""
    total = sum(n for _, n in depths)
    cost = {k: total * k / 8 + entries * sum(n for d, n in depths if d > k) for k in range(min(b, max(1, entries // 8)), b + 1)}
    return min(cost, key=lambda k: (cost[k], k))


def _moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry's parts' componentwise floor(sum / count); those of no part stay. At most parts * entries rows reach the driver."""
    parts, _, d = books.shape
    each = state.select("vector", F.posexplode("code").alias("part", "entry"))
    sums = [F.sum(F.col("vector")[F.col("part") * d + i].cast("long")).alias(f"s{i}") for i in range(d)]
    out = books.copy()
    for row in each.groupBy("part", "entry").agg(F.count("*").alias("n"), *sums).collect():
        out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(d)]
    return out


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (hexadecimal) and error of every usable row of vectors (vec_id, embedding, label), and the codebooks.

    Rows whose vector is null or holds null or non-finite components are left out; other columns are not
    carried on. Repeated rows and ids are rows of their own. The codebooks start as the vectors of the
    smallest ids (at most 256 entries), ties by components, null ids last; with fewer rows there are fewer
    entries, without rows none. Shorter vectors, and lengths that don't divide, count as padded with zeros.
    Components beyond 2**27 after scaling count as 2**27.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", "label", whole_components(F.col("embedding"), scale).alias("vector"))
    rows, width, largest = padded(rows, "vector", parts)
    rows = materialize(rows)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(min(entries, 256)).select("vector").collect()
    books = np.array([r["vector"] for r in first], np.int64).reshape(len(first), parts, width // parts).transpose(1, 0, 2).copy()
    kind, k = exact_type(width, largest), len(first)
    b = old = max(0, min(k - 1, max(1, k // 4)))
    state, drift = rows, None
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}"
    for _ in range(rounds if k else 0):
        shared = spark.sparkContext.broadcast(_Round(books, drift, old, b, width, kind))
        new = materialize(state.mapInArrow(_assigner(shared), f"{schema}, vector array<int>, state binary, code array<int>, depth array<int>"))
        release(state)
        state, moved = new, _moved(new, books)
        step = moved - books
        books, old = moved, b
        if drift is not None:  # the first round lists everything anew and tells nothing
            b = _shorter([(r["d"], r["n"]) for r in state.select(F.explode("depth").alias("d")).groupBy("d").agg(F.count("*").alias("n")).collect()], b, k)
        drift = _roots((step * step).sum(2))[1]
    shared = spark.sparkContext.broadcast(_Round(books, drift, old, b, width, kind))
    return state.mapInArrow(_encoder(shared), f"{schema}, code string, error long"), books


def code_report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (null where the sum doesn't fit a long) and codebooks_sha256."""
    codes, books = encode_vectors(vectors)
    codes = materialize(codes.withColumns({"_null": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}))
    groups = codes.groupBy("_null", "_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n"))
    out = hot_join(codes, groups, ["_null", "_label"], "_n", codes.count())
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
