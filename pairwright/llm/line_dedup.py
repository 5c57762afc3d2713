"""Line deduplication by content-defined chunks of lines.

A line ends with a newline, a sentence, or after a word whose hash says so (one in FOLD), so that a passage
in the midst of long lines has lines of its own. A rolling hash over the last WINDOW line hashes, cleared
where a text begins, ends a chunk where it is divisible by DIVISOR. So boundaries depend on nearby lines
alone, and from a passage's third line on they are the same in every host. Chunks of several lines that are
found more than once, in one document or many, belong to the first one (by doc_id, then place). Those of a
document that follow its first ones at the same distance are a run; it is compared with them word by word,
and then on into the chunks beside, as far as the words agree: a passage's boundaries lie there, as only its
first WINDOW lines may be cut otherwise in another host. What agrees goes, if it is a passage:
`least_words` words in all, or three lines of LINE_WORDS words. White space doesn't count. Whatever goes has
its like further on top, so of text that repeats itself one period stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.llm.common import columns_of, hot_join, materialize, ship, slices
from pairwright.llm.words import Words, words_of

WINDOW, DIVISOR, FOLD = 2, 2, 3
#: Chunks beside a repeated one in which a passage may begin or end: one that the host began, and one for each line that its window reaches into.
BESIDE = WINDOW + 1
#: Lines and words of chunks that are looked up, and words of three lines that are a passage.
LEAST_LINES, CHUNK_WORDS, LINE_WORDS = 2, 4, 10
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LETTERS = np.random.default_rng(0).integers(1, 1 << 63, 256, np.uint64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BYTE = np.arange(256)
_IN_WORD = (_BYTE != 32) & ((_BYTE < 9) | (_BYTE > 13))
_STOPS = np.isin(_BYTE, list(b".!?"))


@dataclass
class Cut:
    """Chunks of a batch: words, first word of every chunk (and the end), lines, hash; chunk_at: first chunk of every text (and the end)."""

    words: Words
    word_at: np.ndarray
    first: np.ndarray
    lines: np.ndarray
    hashes: np.ndarray
    chunk_at: np.ndarray


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _sums(values: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of every stretch of values, modulo 2**64."""
    if not len(first):
        return np.zeros(0, np.uint64)
    lengths = ends - first
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = _BASE
    np.cumprod(powers, out=powers)
    within = np.arange(len(values)) - np.repeat(first, lengths)
    return _mixed(np.add.reduceat(values * powers[within], first))


def cut(texts: pa.Array) -> Cut:
    words = words_of(texts, _IN_WORD)
    n, word_at = len(words.ids), np.concatenate([[0], np.cumsum(words.counts)])
    offsets = np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1]
    letters = np.frombuffer(words.dictionary.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    own = _sums(_LETTERS[letters], offsets[:-1], offsets[1:])[words.ids] if n else np.zeros(0, np.uint64)
    base = np.repeat(words.base, words.counts)
    newlines = np.concatenate([[0], np.cumsum(words.data == 10)])
    ends = _STOPS[words.data[base + words.end - 1]] | ((own >> np.uint64(20)) % np.uint64(FOLD) == 0) if n else np.zeros(0, bool)
    ends[:-1] |= newlines[(base + words.start)[1:]] > newlines[(base + words.end)[:-1]]
    last = word_at[1:][words.counts > 0] - 1
    ends[last] = True
    line_end = np.flatnonzero(ends) + 1
    line_first = np.concatenate([[0], line_end[:-1]]) if n else line_end
    line = _sums(own, line_first, line_end)
    rolled, before = line.copy(), line
    fresh = np.isin(line_first, word_at[:-1][words.counts > 0])  # a text's first line
    clear = np.zeros(len(line), bool)
    for k in range(1, WINDOW):
        before = np.concatenate([np.zeros(1, np.uint64), before[:-1]])
        clear = np.concatenate([[False], clear[:-1]]) | fresh if k > 1 else fresh
        rolled = rolled * _BASE + np.where(clear, np.uint64(0), before)
    closes = _mixed(rolled) % np.uint64(DIVISOR) == 0
    closes |= np.isin(line_end, last + 1)
    at = np.flatnonzero(closes)
    first = np.concatenate([[0], line_end[at]])
    lines = np.diff(np.concatenate([[-1], at]))
    return Cut(words, word_at, first, lines, _sums(own, first[:-1], first[1:]) if n else np.zeros(0, np.uint64), np.searchsorted(first, word_at))


def _looked_up(c: Cut) -> np.ndarray:
    return np.flatnonzero((c.lines >= LEAST_LINES) & (np.diff(c.first) >= CHUNK_WORDS))


_CHUNKS = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("last", pa.int32())]))


def _chunk_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, key and the chunks to look up: hash, and first and last word (exclusive)."""
    for b in slices(batches, 2, 4_000_000):
        c = cut(b.column(2))
        wanted = _looked_up(c)
        text = np.searchsorted(c.chunk_at, wanted, "right") - 1
        offsets = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32)
        at = c.first[wanted] - c.word_at[text]
        fields = [c.hashes[wanted].view(np.int64), at.astype(np.int32), (at + c.first[wanted + 1] - c.first[wanted]).astype(np.int32)]
        chunks = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(f) for f in fields], fields=list(_CHUNKS.value_type)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), chunks], names=["doc_id", "key", "chunks"])


#: Bytes of fetched words that leave in one batch.
_OUT = 8_000_000


def _run_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, at, n, lead and words of the runs asked for: columns key, text and wanted (at, n).

    words are the run's and those beside it, of which `lead` come before: of BESIDE chunks, and of all up
    to the next one that is looked up by itself.
    """

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["first_key", "first_at", "n_words", "lead", "words"])

    for b in slices(batches, 1, 4_000_000):
        c, rows, held = cut(b.column(1)), [], 0
        known = np.concatenate([[-1], _looked_up(c), [len(c.lines)]])
        for i, (key, text, wanted) in enumerate(zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True)):
            raw, own = text.as_py(), int(c.word_at[i])
            for w in wanted:
                x, y = own + w["at"], own + w["at"] + w["n"]
                k, last = int(np.searchsorted(c.first, x, "right")) - 1, int(np.searchsorted(c.first, y)) - 1
                before, after = known[np.searchsorted(known, k) - 1], known[np.searchsorted(known, last, "right")]
                low, high = c.first[max(min(k - BESIDE, before), c.chunk_at[i])], c.first[min(max(last + BESIDE, after) + 1, c.chunk_at[i + 1])]
                rows.append((key, w["at"], w["n"], x - int(low), b" ".join(raw[c.words.start[low] : c.words.end[high - 1]].split())))
                held += len(rows[-1][4])
                if held > _OUT:
                    yield out(rows)
                    rows, held = [], 0
        yield out(rows)


def _agreement(words: list[bytes], at: int, last: int, lead: int, others: list[bytes]) -> list[tuple[int, int]]:
    """Stretches of words that agree with a run's first occurrence: within at to last, and from there on both sides as far as all agree."""
    shift = lead - at
    if words[at:last] == others[lead : last + shift]:
        inside = [(at, last)]
    else:
        same = [words[i] == others[i + shift] for i in range(at, last)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))) + at
        inside = [(int(i), int(j)) for i, j in edges.reshape(-1, 2)]
    if inside and inside[0][0] == at:
        i = at
        while i > 0 and i + shift > 0 and words[i - 1] == others[i - 1 + shift]:
            i -= 1
        inside[0] = (i, inside[0][1])
    if inside and inside[-1][1] == last:
        j = last
        while j < len(words) and j + shift < len(others) and words[j] == others[j + shift]:
            j += 1
        inside[-1] = (inside[-1][0], j)
    return inside


def _without(text: bytes, gone: list[dict], least_words: int) -> tuple[bytes, int]:
    """The text without the passages whose words are those of a first occurrence, and their number."""
    words = text.split()  # of bytes: at the six ASCII blanks
    out = np.zeros(len(words) + 1, bool)
    for g in gone:
        for i, j in _agreement(words, g["at"], g["last"], g["lead"], g["words"].split()):
            out[i:j] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], out]).astype(np.int8))).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= min(least_words, LINE_WORDS)].tolist()
    if not edges:
        return text, 0
    spans = [m.span() for m in _WORD.finditer(text)]
    kept, at, n = [], 0, 0
    for i, j in edges:
        if j - i < least_words and (j - i < LINE_WORDS or _lines(text, spans, i, j) < 3):
            continue
        kept.append(text[at : spans[i][0]])
        at, n = spans[j - 1][1], n + 1
    if not n:
        return text, 0
    kept.append(text[at:])
    out_parts = [kept[0]]
    for right in kept[1:]:  # of the white space around what went, one piece stays
        left = out_parts.pop()
        a, b = left.rstrip(), right.lstrip()
        gap = left[len(a) :] + right[: len(right) - len(b)]
        out_parts += [a, b"\n" if b"\n" in gap else gap[:1], b] if a else [b]
    return b"".join(out_parts).strip(b"\n\x20"), n


def _lines(text: bytes, spans: list[tuple[int, int]], i: int, j: int) -> int:
    """How many lines or sentences end with words i to j (exclusive)."""
    after = lambda k: text[spans[k][1] : spans[k + 1][0]] if k + 1 < len(spans) else b"\n"
    return sum(text[spans[k][1] - 1 : spans[k][1]] in (b".", b"!", b"?") or b"\n" in after(k) for k in range(i, j))


def _remover(width: int, text_at: int, least_words: int):
    """The first `width` columns with what is in the column after them taken out of the text, and how many passages went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_at):
            texts, gone = b.column(text_at).cast(pa.binary()), b.column(width)
            removed, changed = np.zeros(b.num_rows, np.int32), []
            for i in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)).tolist():
                text, removed[i] = _without(texts[i].as_py(), gone[i].as_py(), least_words)
                if removed[i]:
                    changed.append(text)
            if changed:
                texts = pc.replace_with_mask(texts, pa.array(removed > 0), pa.array(changed, pa.binary()))
            columns = [texts.cast(pa.string()) if i == text_at else b.column(i) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed)], names=[f"c{i}" for i in range(width + 1)])

    return run


def line_dedup(docs: DataFrame, least_words: int = 30) -> DataFrame:
    """docs (doc_id, text and any other columns) with their texts deduplicated, and n_removed, the passages that went.

    n_chars, where there is one, follows. A null text stays null; one that loses all its words becomes
    empty. Rows that repeat both doc_id and text are one document: they lose the same passages. A document
    with a null id comes last; ties of id go by the text's hash. A column n_removed of docs is replaced;
    other columns stay, whatever their names. An empty table gives an empty one.
    """
    ship(docs.sparkSession)
    docs = docs.select(*(c for c, name in zip(columns_of(docs), docs.columns, strict=True) if name != "n_removed"))
    names, width, text_at = docs.columns, len(docs.columns), docs.columns.index("text")
    fields = [T.StructField(f"c{i}", T.StringType() if i == text_at else f.dataType) for i, f in enumerate(docs.schema.fields)]
    doc, text = F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{text_at}").cast("string")
    keyed = docs.toDF(*(f.name for f in fields)).withColumns({f"c{text_at}": text, "key": F.xxhash64(doc, text)})
    texts = keyed.filter(text.isNotNull()).select(doc.alias("doc_id"), "key", text.alias("text"))
    found = materialize(texts.mapInArrow(_chunk_hashes, "doc_id long, key long, chunks array<struct<hash:long,at:int,last:int>>").dropDuplicates(["doc_id", "key"]))
    each = found.select("doc_id", "key", F.explode("chunks").alias("c")).select("doc_id", "key", "c.*")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "at", "last")
    repeated = each.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("p")).filter("n > 1")
    repeated = materialize(repeated.select("hash", "n", F.col("p.key").alias("first_key"), F.col("p.at").alias("first_at")))
    others = hot_join(each, repeated, ["hash"], "n", each.count()).filter("NOT (key = first_key AND at = first_at)")
    # chunks of a document whose first occurrences lie in one document at the same distance are a run
    along = W.partitionBy("key").orderBy("at")
    step = F.struct("first_key", F.col("first_at") - F.col("at"))
    new = F.coalesce(step != F.lag(step).over(along), F.lit(True)).cast("int")
    numbered = others.withColumn("new", new).withColumn("run", F.sum("new").over(along))
    runs = numbered.groupBy("key", "run").agg(F.min("at").alias("at"), F.max("last").alias("last"), F.first("first_key").alias("first_key"), F.min("first_at").alias("first_at"))
    runs = materialize(runs.select("key", "at", "last", "first_key", "first_at", (F.col("last") - F.col("at")).alias("n_words")))
    # each run's words, read once from the document of the first occurrence
    sizes = runs.groupBy("first_key", "first_at", "n_words").agg(F.count("*").alias("n"))
    wanted = sizes.groupBy(F.col("first_key").alias("key")).agg(F.collect_list(F.struct(F.col("first_at").alias("at"), F.col("n_words").alias("n"))).alias("wanted"))
    firsts = texts.select("key", "text").join(wanted, "key").dropDuplicates(["key"]).select("key", "text", "wanted")
    firsts = firsts.mapInArrow(_run_words, "first_key long, first_at int, n_words int, lead int, words binary")
    told = materialize(firsts.join(sizes, ["first_key", "first_at", "n_words"]))
    gone = hot_join(runs, told, ["first_key", "first_at", "n_words"], "n", runs.count())
    gone = gone.groupBy("key").agg(F.collect_list(F.struct("at", "last", "lead", "words")).alias("gone"))
    joined = keyed.join(gone, "key", "left").select(*(f.name for f in fields), "gone")
    out = joined.mapInArrow(_remover(width, text_at, least_words), T.StructType([*fields, T.StructField(f"c{width}", T.IntegerType())])).toDF(*names, "n_removed")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed passages, and n_chars and SHA-256 of what is left."""
    out = line_dedup(docs.select("doc_id", "text"))
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_removed", F.length(left).alias("n_chars"), F.sha2(left, 256).alias("text_sha256"))


def with_text_left(docs: DataFrame) -> DataFrame:
    """docs after line_dedup, without the rows that it left no text; rows that had none before stay, and so does a column n_removed."""
    held = max(docs.columns, key=len) + "_"  # a name that no column has
    out = line_dedup(docs.withColumnRenamed("n_removed", held)).filter("n_removed = 0 OR text <> ''").drop("n_removed")
    return out.withColumnRenamed(held, "n_removed").select(*columns_of(docs))
