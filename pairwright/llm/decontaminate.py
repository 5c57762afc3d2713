"""Benchmark passages in documents, found by an FM-index of each shard.

A shard is a stretch of documents of about SHARD bytes inside a task, or one longer document. Its words get
numbers, its suffixes are sorted whole (every document ends with a mark of its own, so no suffix reaches
into the next), and the Burrows-Wheeler transform becomes a wavelet matrix. All windows of the benchmark
walk backward through it at once; the rows left are followed to the nearest sampled suffix position, and
the occurrences of all windows are merged into spans of words, document by document.

The benchmark goes to the tasks in blocks of `block_windows` windows, one pass over the documents for each
block, so what is broadcast has a bound whatever the benchmark weighs. Spans and items of a block are
added to those of the blocks before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import columns_of, materialize, release, ship, slices
from pairwright.llm.words import Words, words_of

#: Bytes of text that one index holds, and how far apart the sampled suffix positions are.
SHARD, SAMPLED = 8_000_000, 8
#: The contract's words, in text with small letters, and how many make a window.
WORD, WINDOW = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", 10
_BYTE = np.arange(256, dtype=np.uint8)
_SMALL = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_IN_WORD = (_SMALL >= 128) | ((_SMALL >= 97) & (_SMALL <= 122)) | ((_SMALL >= 48) & (_SMALL <= 57))


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """The order of all suffixes of s, whose last symbol occurs once; by prefix doubling, which goes on with ties only."""
    n, bits = len(s), max(1, int(symbols).bit_length())
    deep = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(deep):
        key <<= bits
        key[: max(n - k, 0)] |= s[k:]
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(tied):
        at = order[tied]
        key = rank[at] * n + rank[at + deep]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = tied[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        tied = tied[~(first & np.append(first[1:], True))]
        deep *= 2
    return order


class _Bits:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class FMIndex:
    """Full-text index of texts of numbered words (0 to symbols - 1), each text ended by a mark."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, symbols: int, sampled: int = SAMPLED):
        texts = len(counts)
        self.starts = np.concatenate([[0], np.cumsum(counts + 1)])
        n = int(self.starts[-1])
        marks = self.starts[1:] - 1
        is_word = np.ones(n, bool)
        is_word[marks] = False
        s = np.empty(n, np.int64)
        s[is_word], s[marks] = ids + texts, np.arange(texts)
        order = suffix_array(s, symbols + texts)
        s[is_word] -= texts - 1  # all marks are one symbol from here on
        s[marks] = 0
        self.n, self.symbols = n, symbols
        self.first = np.concatenate([[0, texts], texts + np.cumsum(np.bincount(ids, minlength=symbols))])
        bwt = s[order - 1].astype(np.int32)
        keep = order % sampled == 0
        begins = np.zeros(n, bool)
        begins[self.starts[:-1]] = True
        keep |= begins[order]  # no walk passes a text's beginning
        self.kept, self.positions = _Bits(keep), order[keep]
        self.levels: list[tuple[int, _Bits, int]] = []
        for level in range(max(1, int(symbols).bit_length()) - 1, -1, -1):
            bits = (bwt >> level & 1).astype(bool)
            ones = _Bits(bits)
            self.levels.append((level, ones, n - ones.ones))
            bwt = np.concatenate([bwt[~bits], bwt[bits]])
        every = np.arange(symbols + 1)
        self.base = self._down(every, np.zeros(symbols + 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often the symbol stands among the transform's first i."""
        return self._down(symbol, i) - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which phrases occur, and their first and last row (exclusive). phrases: word numbers, aligned at the right, each all known."""
        which = np.arange(len(phrases))
        width = phrases.shape[1]
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(width):
            going = which[lengths[which] > step]
            if not len(going):
                break
            symbol = phrases[going, width - 1 - step] + 1
            both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low[going], high[going]]))
            low[going] = self.first[symbol] + both[: len(going)]
            high[going] = self.first[symbol] + both[len(going) :]
            which = which[low[which] < high[which]]
        return which, low[which], high[which]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at these rows."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        going, rows = np.arange(len(rows)), rows.copy()
        while len(going):
            at = rows[going]
            found = self.kept.get(at)
            out[going[found]] = self.positions[self.kept.rank(at[found])]
            going = going[~found]
            i = at = rows[going]
            symbol = np.zeros(len(i), np.int64)
            for level, bits, zeros in self.levels:
                one, ones = bits.get(i), bits.rank(i)
                symbol |= one.astype(np.int64) << level
                i = np.where(one, zeros + ones, i - ones)
            rows[going] = self.first[symbol] + i - self.base[symbol]
            steps[going] += 1
        return out + steps


@dataclass(frozen=True)
class Phrases:
    """A block of windows: word numbers aligned at the right, lengths, and the items of each window."""

    words: list[bytes]
    windows: np.ndarray
    lengths: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list[str]


def _phrases(rows: pa.Table) -> Phrases:
    """From rows (window: words joined by blanks, item)."""
    windows, names = rows.column("window").combine_chunks().dictionary_encode(), rows.column("item").combine_chunks().dictionary_encode()
    texts = [w.split(" ") for w in windows.dictionary.to_pylist()]
    number: dict[str, int] = {}
    matrix = np.zeros((len(texts), WINDOW), np.int64)
    for i, words in enumerate(texts):
        matrix[i, WINDOW - len(words) :] = [number.setdefault(w, len(number)) for w in words]
    of = windows.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.argsort(of, kind="stable")
    item_at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))])
    items = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)[by]
    return Phrases([w.encode() for w in number], matrix, np.array([len(w) for w in texts], np.int64), item_at, items, names.dictionary.to_pylist())


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for counts[0] numbers, then the next ones."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _occurrences(found: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the window, text and first word of every occurrence."""
    none = np.zeros(0, np.int64)
    known = pc.index_in(pa.array(phrases.words, pa.large_binary()), value_set=found.dictionary) if phrases.words else pa.array([], pa.int32())
    number = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if not (number >= 0).any():
        return none, none, none
    matrix = number[phrases.windows]
    pad = np.arange(WINDOW) < WINDOW - phrases.lengths[:, None]
    whole = np.flatnonzero(((matrix >= 0) | pad).all(axis=1))
    if not len(whole):
        return none, none, none
    index = FMIndex(found.ids, found.counts, len(found.dictionary))
    which, low, high = index.search(matrix[whole], phrases.lengths[whole])
    times = high - low
    at = index.locate(_spread(low, times))
    text = np.searchsorted(index.starts, at, "right") - 1
    return np.repeat(whole[which], times), text, at - index.starts[text]


def _spans(window: np.ndarray, text: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, first word and last word (exclusive) of the merged occurrences, in order."""
    by = np.lexsort((at, text))
    text, at, end = text[by], at[by], at[by] + lengths[window[by]]
    if not len(at):
        return text, at, end
    far = np.int64(1) << 40  # words of one text are fewer
    reach = np.maximum.accumulate(text * far + end)
    new = np.concatenate([[True], text[1:] * far + at[1:] > reach[:-1]])
    begins = np.flatnonzero(new)
    last = np.append(begins[1:], len(at)) - 1
    return text[begins], at[begins], reach[last] - text[begins] * far


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS_SQL = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("word_spans", _SPANS_SQL), T.StructField("spans", _SPANS_SQL), T.StructField("items", T.ArrayType(T.StringType()))]


def _searcher(block, text_at: int, width: int, with_text: bool):
    """The first `width` columns and _ADDED; a batch that has more than that brings the spans and items of the blocks before."""

    def shard(b: pa.RecordBatch) -> list[pa.Array]:
        texts, phrases = b.column(text_at), block.value
        found = words_of(texts, _IN_WORD, _SMALL)
        window, text, at = _occurrences(found, phrases)
        n, lengths = b.num_rows, phrases.lengths
        items: list[list[str]] = [[] for _ in range(n)]
        pairs = np.unique(text * len(lengths) + window) if len(window) else window
        of, windows = (pairs // len(lengths), pairs % len(lengths)) if len(pairs) else (pairs, pairs)
        times = phrases.item_at[windows + 1] - phrases.item_at[windows] if len(pairs) else pairs
        named = phrases.items[_spread(phrases.item_at[windows], times)] if len(pairs) else pairs
        pairs = np.unique(np.repeat(of, times) * max(1, len(phrases.names)) + named) if len(pairs) else pairs
        for p in pairs.tolist():
            items[p // len(phrases.names)].append(phrases.names[p % len(phrases.names)])
        items = [sorted(x) for x in items]
        if b.num_columns > width:
            old = b.column(width).to_pylist()
            before = np.array([(i, s["start"], s["end"]) for i, row in enumerate(old) for s in row or ()], np.int64).reshape(-1, 3)
            window = np.concatenate([window, len(lengths) + np.arange(len(before))])
            lengths = np.concatenate([lengths, before[:, 2] - before[:, 1]])
            text, at = np.concatenate([text, before[:, 0]]), np.concatenate([at, before[:, 1]])
            items = [sorted({*(x or ()), *y}) for x, y in zip(b.column(width + 1).to_pylist(), items, strict=True)]
        text, first, last = _spans(window, text, at, lengths)
        hit = np.bincount(text, last - first, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64)
        word_at = np.concatenate([[0], np.cumsum(found.counts)])
        spans: list[list[dict]] = [[] for _ in range(n)]
        places: list[list[dict]] = [[] for _ in range(n)]
        whole: dict[int, bytes] = {}
        for i, f, e in zip(text.tolist(), first.tolist(), last.tolist(), strict=True):
            if i not in whole:
                whole = {i: texts[i].cast(pa.binary()).as_py()}
                byte = char = 0
            ends = []
            for place in (int(found.start[word_at[i] + f]), int(found.end[word_at[i] + e - 1])):
                char += len(whole[i][byte:place].decode())
                byte = place
                ends.append(char)
            spans[i].append({"start": f, "end": e})
            places[i].append({"start": ends[0], "end": ends[1]})
        own = [b.column(c) for c in range(width)]
        if not with_text:
            own[text_at] = pa.nulls(n, pa.string())
        return [*own, pa.array(found.counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, _SPANS), pa.array(places, _SPANS), pa.array(items, pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_at, SHARD):
            yield pa.RecordBatch.from_arrays(shard(b), names=[f"c{i}" for i in range(width + len(_ADDED))])

    return run


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """window (words joined by blanks) and item of every window of every item, each pair once.

    An item of fewer words, but not none, is one window; a null text has none. A null item_id is one more item, named by the empty string.
    """
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0))
    rows = benchmark.filter("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).filter("size(words) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (WINDOW - 1))))
    return rows.select("item", "words", at.alias("at")).select(F.concat_ws(" ", F.slice("words", F.col("at"), WINDOW)).alias("window"), "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, block_windows: int = 500_000, with_text: bool = True) -> DataFrame:
    """docs (text and any other columns) with n_words, n_hit, word_spans, spans and items.

    word_spans count words from 0, spans code points; both are merged, in order, ends exclusive. items are
    the ids, as sorted strings, of the benchmark's items with a window in the text. benchmark: item_id and
    text. A null text, like an empty one, has no words and stays as it is; repeated rows and rows without
    ids are searched each by itself; with an empty benchmark nothing is hit. Columns of docs named like a
    result are replaced. with_text=False leaves texts null, which spares sending them back.
    """
    spark = docs.sparkSession
    ship(spark)
    windows = materialize(benchmark_windows(benchmark))
    blocks = max(1, math.ceil(windows.count() / block_windows))
    base = docs.select(*(c for c, name in zip(columns_of(docs), docs.columns, strict=True) if name not in {f.name for f in _ADDED}))
    width, text_at = len(base.columns), base.columns.index("text")
    names, fields = base.columns, [f if i != text_at else T.StructField("text", T.StringType()) for i, f in enumerate(base.schema.fields)]
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*fields, *_ADDED])])
    rows = base.toDF(*(f"c{i}" for i in range(width))).withColumn(f"c{text_at}", F.col(f"c{text_at}").cast("string"))
    before = None
    for k in range(blocks):
        part = windows if blocks == 1 else windows.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(_phrases(part.toArrow()))
        last = k == blocks - 1
        out = rows.mapInArrow(_searcher(block, text_at, width, with_text or not last), plain)
        if not last:
            out = materialize(out)
            if before is not None:
                release(before)
            before = out
            rows = out.select(*(f"c{i}" for i in range(width)), f"c{width + 2}", f"c{width + 4}")
    return out.toDF(*names, *(f.name for f in _ADDED))


def _without(text: Column, spans: Column) -> Column:
    """The text without its spans of code points."""
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(begins, ends, lambda b, e: F.substring(text, (b + 1).cast("int"), (e - b).cast("int")))
    return F.when(F.size(spans) > 0, F.concat_ws("", kept)).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs with the benchmark's passages taken out of their texts, from the first word of a span to its last.

    White space and punctuation around a span stay, and so does every row, emptied or not; n_chars, where
    there is one, follows. Nulls, ties and empty tables: as for contamination().
    """
    out = contamination(docs, benchmark, **options)
    out = out.withColumn("text", _without(F.col("text"), F.col("spans")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*(c for c, name in zip(columns_of(out), out.columns, strict=True) if name in docs.columns))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans to remove."""
    out = contamination(docs.select("doc_id", "text"), benchmark, with_text=False)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
