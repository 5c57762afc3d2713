"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian whose covariance is shrunk twice: towards the pooled one, then towards a
multiple of the identity. A document's score is the logistic of the difference of the two log densities,
whose Mahalanobis terms come from the classes' Cholesky factors, inverted once on the driver. Training
needs only counts, sums and sums of products per class, so Spark adds them up over all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import held_out, materialize, ship, slices
from pairwright.llm.quality_rules import SYMBOLS, repeated_words

FEATURES = ("log_words", "word_chars", "symbols", "dup_lines", "repeats", "upper", "exclaim", "digits", "log_line_words", "distinct", "ended_lines")
_BLANKS = list(b" \t\n\x0b\x0c\r")
_SYMBOLS = list(SYMBOLS)


def features(text: bytes) -> list[float]:
    """Counts as logarithms, ratios as square roots, so that the classes come closer to Gaussians."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    raw = np.frombuffer(text, dtype=np.uint8)
    n = np.bincount(raw, minlength=256)
    points = int(n.sum() - n[0x80:0xC0].sum())
    chars = max(points - int(n[_BLANKS].sum()), 1)
    # upper case: ASCII and the Latin-1 letters, whose second UTF-8 byte is below 0x9F
    latin = np.flatnonzero(raw[:-1] == 0xC3) if n[0xC3] else np.empty(0, dtype=np.int64)
    upper_latin = int((raw[latin + 1] < 0x9F).sum())
    upper = int(n[65:91].sum()) + upper_latin
    letters = max(upper + int(n[97:123].sum()) + len(latin) - upper_latin, 1)
    w, k = max(len(words), 1), max(len(lines), 1)
    root = lambda a, b: (a / b) ** 0.5
    ended = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    return [
        float(np.log1p(len(words))), chars / w, root(int(n[_SYMBOLS].sum()), chars), root(len(lines) - len(set(lines)), k), root(repeated_words(words), w),
        root(upper, letters), root(int(n[33]), chars), root(int(n[48:58].sum()), chars), float(np.log1p(len(words) / k)), root(len(set(words)), w), ended / k,
    ]


def _features_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 1):
        found = [features(x.as_py() or b"") for x in b.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "f"])


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and f, the FEATURES of its whole text; a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_features_all, "doc_id long, f array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the covariance's Cholesky factor, and log prior less half the log determinant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        logs = [o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return logs[1] - logs[0]


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For labels 0 and 1 of rows (f, label): count, sums and sums of products. Two rows reach the driver."""
    d = len(FEATURES)
    f = [F.get("f", F.lit(i)) for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(f)] + [F.sum(f[i] * f[j]).alias(f"p{i}_{j}") for i, j in pairs]
    out = {}
    for r in rows.filter("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums).collect():
        products = np.zeros((d, d))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"]
        out[r.label] = (float(r.n), np.array([r[f"s{i}"] for i in range(d)]), products)
    return out


def fit(sums: dict, to_pooled: float = 0.1, to_identity: float = 0.01) -> Discriminant | None:
    """None where a class has no rows."""
    if set(sums) != {0, 1}:
        return None
    means = {k: s / n for k, (n, s, _) in sums.items()}
    scatter = {k: p - n * np.outer(means[k], means[k]) for k, (n, _, p) in sums.items()}
    total = sum(n for n, _, _ in sums.values())
    pooled = (scatter[0] + scatter[1]) / total
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))  # the features' own variances stand in for the identity
    factors, offsets = [], []
    for k in (0, 1):
        n = sums[k][0]
        cov = (1 - to_pooled) * scatter[k] / n + to_pooled * pooled
        lower = np.linalg.cholesky((1 - to_identity) * cov + to_identity * scale)
        factors.append(np.linalg.inv(lower))
        offsets.append(np.log(n / total) - np.log(np.diag(lower)).sum())
    return Discriminant(np.array([means[0], means[1]]), np.array(factors), np.array(offsets))


def score(f: Column, model: Discriminant | None) -> Column:
    """0 to 1, higher: label 1 likelier; 0.5 where there is no model."""
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        z = model.log_odds(np.stack(x.to_numpy())) if len(x) else np.empty(0)
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return of(f)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    labels (doc_id, quality) teach only by rows that aren't held out; null labels and ids don't. Repeated
    rows count as often. Empty and null texts have features like any other text, and so a score. Other columns
    don't matter, whatever their names; an empty table gives none. Without both labels every score is 0.5.
    """
    found = materialize(document_features(docs))
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(~held_out(F.col("doc_id")) & F.col("label").isNotNull())
    model = fit(class_sums(found.join(taught, "doc_id")))
    out = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("f"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
