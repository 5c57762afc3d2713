"""N-gram Jaccard join over prefix trees.

A document's set is its distinct word shingles, as 64-bit hashes in one global order: those known to be
frequent last, then by hash. Two sets as similar as asked share one of the first tokens of both (prefix
filter), so documents meet in groups by such tokens. Two steps then find links:

1. Odd sketches (parity bits of a set) differ in at most as many bits as the sets differ in elements.
   A breadth-first walk over each group's sketches joins what may be similar into clusters; it drops no
   link, as it only tells apart sets whose sketches prove them apart.
2. A cluster's sets are stored in a path-compressed trie. A set is looked up against all stored ones at
   once: the overlap with a node's path is shared by everything below, and subtrees are pruned where even
   a full match of the remaining tokens falls short, or where everything is connected already.

Both walks yield links that span components instead of all pairs, and groups of any size are dealt out in
blocks (see components.spanning_links), so a group of near copies costs about its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import hot_join, materialize, ship, slices
from pairwright.llm.components import spanning_links
from pairwright.operators.graph import components

#: Two sets are linked when LINK[1] * intersection >= LINK[0] * union.
LINK = (80, 100)
WIDTH = 5
_ROOT = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, known: _Hashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams, A-Z lower-cased; one of the whole if it has fewer words."""
    words = text.lower().split()  # of bytes: ASCII letters and blanks only
    if len(known) > 200_000:
        known.clear()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(width, len(words))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * _ROOT + h[i : len(h) - k + 1 + i]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def least_overlap(size: int) -> int:
    """The least intersection that a set of this size has with any linked one."""
    return -(-LINK[0] * size // LINK[1])


def is_linked(both: int, a: int, b: int) -> bool:
    return LINK[1] * both >= LINK[0] * (a + b - both) and both > 0


def most_apart(total: np.ndarray | int) -> np.ndarray | int:
    """The most elements in which two linked sets of this total size differ."""
    return total * (LINK[1] - LINK[0]) // (LINK[1] + LINK[0])


def odd_sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bits, at least as many as tokens and a power of two of them, so that longer ones fold onto shorter."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens >> np.uint64(11)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


# ---- signatures -------------------------------------------------------------------------------------------


def _repeats(width: int, at_once: int = 2_000_000):
    """Tokens that documents of one task share, with how many of them; the null token counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, total = _Hashes(), [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                token, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["token", "n"])

        for b in slices(batches, 0):
            for text in b.column(0).cast(pa.binary()):
                held.append(shingles(text.as_py() or b"", known, width))
                size += len(held[-1])
                total += len(held[-1])
                if size >= at_once:
                    yield from flush()
                    held, size = [], 0
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["token", "n"])

    return run


def frequent_tokens(docs: DataFrame, width: int, most: int, least: int = 32) -> np.ndarray:
    """Tokens that at least max(least, total / most) documents share within tasks: at most `most` of them.

    All documents are counted; what a task counts is a lower bound of a token's frequency, which is enough
    to put passages that many documents share at the end of the global order.
    """
    found = materialize(docs.select("text").mapInArrow(_repeats(width), "token long, n long"))
    total = found.filter("token IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = found.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(least, -(-total // most)))
    return np.sort(often.select("token").toArrow().column(0).to_numpy().astype(np.int64)).view(np.uint64)


_SIGNATURE = "doc_id long, n long, key binary, prefix array<long>, sketch binary"


def _signatures(width: int, frequent):
    """A set's key is a digest of it; prefix and sketch only come with the first one of its key in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, often = _Hashes(), set(), np.sort(frequent.value)
        for b in slices(batches, 1):
            n, key, prefix, sketch = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                tokens = shingles(text.as_py() or b"", known, width)
                n.append(len(tokens))
                key.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                if not len(tokens) or i is None or key[-1] in seen:
                    prefix.append([])
                    sketch.append(None)
                    continue
                seen.add(key[-1])
                rare = np.ones(len(tokens), dtype=bool)
                if len(often):
                    rare = often[np.minimum(np.searchsorted(often, tokens), len(often) - 1)] != tokens
                prefix.append(np.concatenate([tokens[rare], tokens[~rare]])[: len(tokens) - least_overlap(len(tokens)) + 1].view(np.int64))
                sketch.append(odd_sketch(tokens).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=[x.split()[0] for x in _SIGNATURE.split(", ")])

    return run


_FEW = 16


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g and doc of every token (sorted: token, doc) that two or more documents share.

    Small groups are named by their members, so that the many tokens which the same few documents share
    make one group; larger ones by their token, passed on as they come.
    """
    token, few, streaming = None, [], False
    g: list[int] = []
    doc: list[int] = []
    done: set[int] = set()

    def close() -> None:
        if len(few) > 1:
            name = xxhash.xxh64_intdigest(np.array(few, dtype=np.int64).tobytes()) - (1 << 63)
            if name not in done:
                if len(done) > 500_000:
                    done.clear()
                done.add(name)
                g.extend([name] * len(few))
                doc.extend(few)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(doc, pa.int64())], names=["g", "doc"])

    for b in batches:
        t, d = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(t):
            continue
        # tokens with one row, away from the batch's ends, are alone
        alone = np.zeros(len(t), dtype=bool)
        alone[1:-1] = (t[1:-1] != t[:-2]) & (t[1:-1] != t[2:])
        for x, i in zip(t[~alone].tolist(), d[~alone].tolist(), strict=True):
            if x != token:
                close()
                token, few, streaming = x, [], False
            if streaming:
                g.append(x)
                doc.append(i)
            elif not few or few[-1] != i:
                few.append(i)
                if len(few) > _FEW:
                    g.extend([x] * len(few))
                    doc.extend(few)
                    few, streaming = [], True
        if g:
            yield out()
            g, doc = [], []
    close()
    if g:
        yield out()


# ---- linkers ----------------------------------------------------------------------------------------------


def _fold(sketch: np.ndarray) -> np.ndarray:
    """The sketch of half as many bytes."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def sketch_links(group: pa.Table) -> Iterator[tuple[int, int]]:
    """Row pairs that span what the sketches can't tell apart; columns n and sketch.

    Sizes of linked sets differ by a fourth at most, so their sketches' lengths are equal or next to each
    other, and the longer one is folded.
    """
    n = group.column("n").to_numpy()
    raw = group.column("sketch").to_pylist()
    length = np.array([len(x) for x in raw])
    free: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        free[size] = rows, np.frombuffer(b"".join(raw[i] for i in rows.tolist()), dtype=np.uint8).reshape(len(rows), size)

    def near(i: int) -> Iterator[int]:
        """Takes what may be linked with row i out of the free rows."""
        mine, size = np.frombuffer(raw[i], dtype=np.uint8), len(raw[i])
        for other in (size // 2, size, 2 * size):
            if other not in free:
                continue
            rows, sketches = free[other]
            total = n[rows] + n[i]
            may = np.flatnonzero(np.abs(n[rows] - n[i]) <= most_apart(total))
            if not len(may):
                continue
            theirs = sketches[may]
            apart = (_fold(theirs) ^ mine) if other > size else (theirs ^ (_fold(mine) if other < size else mine))
            hit = may[np.bitwise_count(np.ascontiguousarray(apart).view(np.uint64)).sum(axis=1) <= most_apart(total[may])]
            if len(hit):
                yield from rows[hit].tolist()
                kept = np.delete(rows, hit), np.delete(sketches, hit, axis=0)
                if len(kept[0]):
                    free[other] = kept
                else:
                    del free[other]

    while free:
        size = next(iter(free))
        rows, sketches = free[size]
        walk = [int(rows[0])]
        free[size] = rows[1:], sketches[1:]
        if len(rows) == 1:
            del free[size]
        while walk and free:
            i = walk.pop()
            for j in near(i):
                yield i, j
                walk.append(j)


class _Node:
    """Tokens of a path, the sets below, and how many of them are not yet connected."""

    __slots__ = ("tokens", "children", "ends", "depth", "least", "most", "left", "parent")

    def __init__(self, tokens: np.ndarray, depth: int, parent: _Node | None):
        self.tokens, self.depth, self.parent = tokens, depth + len(tokens), parent
        self.children, self.ends = [], []
        self.least, self.most, self.left = 1 << 60, 0, 0


class Trie:
    """Path-compressed trie of ordered token sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.home: list[_Node | None] = [None] * len(sets)
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())  # big-endian: by tokens
        self.root = _Node(np.empty(0, dtype=np.uint64), 0, None)
        stack = [(self.root, order)]
        while stack:
            node, rows = stack.pop()
            node.least, node.most, node.left = min(len(sets[i]) for i in rows), max(len(sets[i]) for i in rows), len(rows)
            node.ends = [i for i in rows if len(sets[i]) == node.depth]
            for i in node.ends:
                self.home[i] = node
            rows = [i for i in rows if len(sets[i]) > node.depth]
            at = 0
            while at < len(rows):
                first, end = sets[rows[at]], at + 1
                while end < len(rows) and sets[rows[end]][node.depth] == first[node.depth]:
                    end += 1
                # rows are sorted, so the first and last of a run share what all of it shares
                tail, other = first[node.depth :], sets[rows[end - 1]][node.depth :]
                k = min(len(tail), len(other))
                differ = np.flatnonzero(tail[:k] != other[:k])
                child = _Node(tail[: int(differ[0]) if len(differ) else k], node.depth, node)
                node.children.append(child)
                stack.append((child, rows[at:end]))
                at = end

    def remove(self, i: int) -> None:
        node = self.home[i]
        node.ends.remove(i)
        while node:
            node.left -= 1
            node = node.parent

    def linked(self, query: np.ndarray) -> list[int]:
        """Sets left in the trie that are linked with the query."""
        out, size = [], len(query)
        stack = [(child, 0, 0) for child in self.root.children]
        while stack:
            node, both, at = stack.pop()
            if not node.left or node.most < least_overlap(size) or size < least_overlap(node.least):
                continue
            # query[at:] is what comes after the path so far; the node's tokens are looked up in it
            place = at + np.searchsorted(query[at:], node.tokens)
            both += int((query[np.minimum(place, size - 1)] == node.tokens).sum()) if at < size else 0
            last = int(place[-1]) if len(place) else at
            at = last + 1 if last < size and len(node.tokens) and query[last] == node.tokens[-1] else last
            # even if all that remains agrees, the smallest set below must be reachable
            best = both + min(size - at, node.most - node.depth)
            if LINK[1] * best < LINK[0] * (size + max(node.least, best) - best):
                continue
            out.extend(i for i in node.ends if is_linked(both, size, len(self.sets[i])))
            stack.extend((child, both, at) for child in node.children)
        return out


def trie_links(width: int):
    """Row pairs that span the components of a group's documents; column text."""

    def links(group: pa.Table) -> Iterator[tuple[int, int]]:
        known = _Hashes()
        sets = [shingles(t.as_py() or b"", known, width) for t in group.column("text").cast(pa.binary())]
        rows = [i for i, s in enumerate(sets) if len(s)]
        trie = Trie([sets[i] for i in rows])
        free = dict.fromkeys(range(len(rows)))
        while free:
            walk = [next(iter(free))]
            del free[walk[0]]
            trie.remove(walk[0])
            while walk and free:
                i = walk.pop()
                for j in trie.linked(trie.sets[i]):
                    yield rows[i], rows[j]
                    walk.append(j)
                    del free[j]
                    trie.remove(j)

    return links


# ---- the join ---------------------------------------------------------------------------------------------


def near_links(docs: DataFrame, signatures: DataFrame, width: int, block: int) -> DataFrame:
    """Links (a, b) that span the components of all documents whose signatures have a prefix."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = signatures.select(F.explode("prefix").alias("token"), F.col("doc_id").alias("doc"))
    dealt = tokens.repartition(n, "token").sortWithinPartitions("token", "doc")
    members = materialize(dealt.mapInArrow(_groups, "g long, doc long").distinct())
    sketches = signatures.filter("sketch IS NOT NULL").select(F.col("doc_id").alias("doc"), "n", "sketch")
    maybe = components(spanning_links(members, sketches, sketch_links, 4 * block))
    clusters = maybe.select(F.col("c").alias("g"), F.col("v").alias("doc"))
    return spanning_links(clusters, docs.select(F.col("doc_id").alias("doc"), "text"), trie_links(width), block)


def near_duplicates(docs: DataFrame, width: int = WIDTH, block: int = 1000, most_frequent: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    Empty, blank and null texts have no shingles and are linked with nothing. Rows that share an id count
    as one document; rows with a null id aren't linked, and their component is null. An empty table gives
    none; other columns don't matter, whatever their names. `block` bounds the
    documents that a task compares at once, not the size of a group.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, width, most_frequent))
    found = materialize(docs.mapInArrow(_signatures(width, frequent), _SIGNATURE))
    label = components(near_links(docs, found, width, block))
    sets = found.filter("n > 0 AND doc_id IS NOT NULL")
    keys = sets.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.min(F.when(F.col("sketch").isNotNull(), F.col("doc_id"))).alias("v"))
    keys = materialize(keys.join(label, "v", "left").select("key", "rep", "size", F.coalesce("c", "v").alias("c")))
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    least = keys.groupBy("c").agg(F.min("rep").alias("component_id"), F.count("*").alias("keys"))
    named = materialize(hot_join(keys, least, ["c"], "keys", total).select("key", "size", "component_id"))
    out = hot_join(sets.select("doc_id", "key", F.col("n").alias("n_shingles")), named, ["key"], "size", total).select("doc_id", "n_shingles", "component_id")
    rest = found.filter("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(rest)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of docs whose id is the smallest of their component; rows without words or id stay."""
    gone = near_duplicates(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    kept = rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti")
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
