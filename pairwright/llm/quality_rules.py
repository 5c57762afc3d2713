"""Quality rules whose thresholds come from quantile sketches for each language and source.

A sketch is a histogram over value ranges that keep six significant bits: counts add up, so sketches of
partitions, sources or languages merge by (weighted) sums, and every quantile is exact to 1/32. A group's
sketch is merged with its language's, which weighs as much as WEIGHT documents, and the language's in the
same way with that of everything; so a group's own documents decide by their number, and there is no size
at which thresholds change their source. From the merged sketch come the group's fences: the tail quantile,
and FENCE times its distance to the median beyond it. A document fails when its value is past a fence by
more than ERRORS standard errors of the value itself, as a short text's rates say little. Thresholds are
joined to the documents, which then pass or fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.common import hot_join, materialize, ship, slices

#: The symbols that are counted, and the base rule's limits.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: For each measure: what is counted, in how much of what, the unit, and how many come at once (a window of
#: three words found twice holds six).
MEASURES = {"mean_word": ("word_chars", "n_words", 1000, 1), "symbols": ("n_symbols", "word_chars", 10000, 1), "dup_lines": ("n_dup_lines", "n_words", 1000, 1), "repeats": ("n_repeat_words", "n_words", 1000, 6)}
#: Measures that fail below a lower fence too.
TWO_SIDED = {"mean_word"}
#: Percent in a tail, distances from the median, standard errors, documents that the larger sketch weighs.
TAIL, FENCE, ERRORS, WEIGHT = 10, 3, 2, 100
#: Merged counts are whole hundredths of documents, so that sums don't depend on their order.
SCALE = 100

_STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    v = len(ids)
    pairs = at[:-1] * v + at[1:]
    if v >= 1 << 20:  # else three ids fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    codes = pairs[:-1] * v + at[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    starts = np.concatenate([order[1:][same], order[:-1][same]])
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # of bytes: parts at the six ASCII blanks
    lines = [x for x in text.split(b"\n") if x.strip()]
    blanks = sum(map(text.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    return len(words), len(text.decode()) - blanks, sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))), len(lines) - len(set(lines)), repeated_words(words)


def _measure_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 3):
        found = [measure(x.as_py() or b"") for x in b.column(3).cast(pa.binary())]
        columns = zip(*found, strict=True) if found else [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(x, pa.int64()) for x in columns)], names=[x.split()[0] for x in _STATS.split(", ")])


def document_stats(docs: DataFrame) -> DataFrame:
    """The base values of every document; a null text has no words, a null lang or source is ''."""
    ship(docs.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank("lang"), blank("source"), F.col("text").cast("string").alias("text")).mapInArrow(_measure_all, _STATS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _value(name: str) -> Column:
    """A measure as a whole number of its units."""
    count, of, unit, _ = MEASURES[name]
    return F.floor(F.lit(unit) * F.col(count) / F.greatest(F.col(of), F.lit(1))).cast("long")


def sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, measure, low (of a value range) and n: the quantile sketches of the rows' measures."""
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), _value(k).alias("value")) for k in MEASURES))
    values = rows.select(*by, F.explode(pairs).alias("m")).select(*by, "m.measure", "m.value")
    bits = "greatest(0, length(bin(value)) - 6)"
    return values.withColumn("low", F.expr(f"shiftleft(shiftright(value, {bits}), {bits})")).groupBy(*by, "measure", "low").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "measure", "low").agg(F.sum("n").alias("n"))


def shrunk(own: DataFrame, larger: DataFrame, by: list[str], larger_by: list[str]) -> DataFrame:
    """Sketches by `by`, each merged with the larger sketch it belongs to at the weight of WEIGHT documents."""
    share = F.floor(F.col("n") * (WEIGHT * SCALE) / F.sum("n").over(W.partitionBy(*larger_by, "measure"))).cast("long")
    groups = own.select(*by, "measure").distinct()
    lent = groups.join(larger.withColumn("n", share), [*larger_by, "measure"]).select(*by, "measure", "low", "n")
    return merge(own.withColumn("n", F.col("n") * SCALE).select(*by, "measure", "low", "n").unionByName(lent), by)


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """by and, for each measure, low_<measure> (null: none) and high_<measure>."""
    w = W.partitionBy(*by, "measure")
    ranks = sketches.withColumns({"upto": F.sum("n").over(w.orderBy("low")), "all": F.sum("n").over(w)})
    quantile = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("all"), F.col("low")))
    q = ranks.groupBy(*by, "measure").agg(quantile(TAIL).alias("tail"), quantile(50).alias("middle"), quantile(100 - TAIL).alias("head"))
    q = q.withColumns({"low": F.when(F.col("measure").isin(*TWO_SIDED), F.col("tail") - FENCE * (F.col("middle") - F.col("tail"))), "high": F.col("head") + FENCE * (F.col("head") - F.col("middle"))})
    one = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{c}_{m}")
    return q.groupBy(*by).agg(*(one(m, c) for m in MEASURES for c in ("low", "high")))


def adaptive_thresholds(passed: DataFrame) -> DataFrame:
    """lang, source, group_n and the fences of every group of `passed`."""
    leaves = materialize(sketch(passed, ["lang", "source"]))
    of_all = merge(leaves, [])
    of_lang = materialize(shrunk(merge(leaves, ["lang"]), of_all, ["lang"], []))
    found = fences(shrunk(leaves, of_lang, ["lang", "source"], ["lang"]), ["lang", "source"])
    sizes = leaves.filter(F.col("measure") == next(iter(MEASURES))).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    return found.join(sizes, ["lang", "source"])


def inside_fences() -> Column:
    """Whether no measure is past a fence by more than ERRORS standard errors (of a count, as if it came by chance)."""
    ok = F.lit(True)
    for name, (count, of, unit, at_once) in MEASURES.items():
        n, size = F.col(count).cast("double"), F.greatest(F.col(of), F.lit(1)).cast("double")
        error = float(ERRORS) * F.sqrt(float(at_once) * (n + float(at_once)))
        ok = ok & ((n - error) * float(unit) <= F.col(f"high_{name}") * size)
        if name in TWO_SIDED:
            ok = ok & ((n + error) * float(unit) >= F.col(f"low_{name}") * size)
    return ok


def quality_rules(docs: DataFrame) -> DataFrame:
    """The base values of every document, base_failed, and kept: inside all fences of its group.

    docs has doc_id, text, lang and source; other columns don't matter, whatever their names. Sketches count
    the documents that pass the base rule; rows that repeat count as often. Blank, null and empty texts fail
    the base rule; a null lang or source is ''. An empty table gives none.
    """
    stats = materialize(document_stats(docs).withColumn("base_failed", base_failed()))
    passed = stats.filter(~F.col("base_failed"))
    limits = materialize(adaptive_thresholds(passed))
    total = limits.agg(F.coalesce(F.sum("group_n"), F.lit(0))).first()[0]
    judged = hot_join(passed, limits, ["lang", "source"], "group_n", total).withColumn("kept", inside_fences())
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*columns).unionByName(stats.filter("base_failed").withColumn("kept", F.lit(False)).select(*columns))
