"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel counts what three-letter subsequences two strings share, each weighted down for every letter it
skips, within a reach of REACH letters, and is divided by the strings' own norms; so an insult with inserted
or masked letters stays close to itself. Landmark strings span the machine's feature space. As the kernel
has explicit features, the trained machine folds into one table of weights over subsequences, with which a
task scores any string by look-ups; the table's size doesn't depend on the data.

A sentence is as toxic as its worst string: a token, folded to letters, or a run of letters set apart
(`i d i o t`). Labels belong to documents, so this is learning from bags: every sentence of a clean document
is labelled clean; of a toxic one's sentences, those that hold its worst strings are labelled toxic. Which
ones these are is told at first by how the kernel's means over toxic and clean sentences differ; with these a
machine is trained on either half of the documents, and what one half's machine finds toxic in the other half
teaches the last one, so that no string counts as toxic on its own document's word alone. Sentences count once
however often copies repeat them. A part of the labelled documents isn't learnt from and sets the scale of
the scores.

Bounds of what is learnt from, all parameters of fit(): `most_docs` labelled documents of either class, those
first by hash; of their strings `most_strings` clean ones, half of them those that the round before found
worst; `landmarks`. What is scored has no bounds.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pairwright.llm.common import held_out, materialize, release, ship, slices

LETTERS = 64  # codes: 0 the edge, 1..62 letters, 63 padding
PAD = LETTERS - 1
REACH, DECAY = 6, 0.6
LONGEST, OVERLAP = 24, 12
#: How many of a text's strings its score rests on, and the margin that stands in for missing ones.
TOP, LEAST = 3, -2.0
PENALTY = 4e-4
#: From which margin on the other half's machine tells a toxic string.
TOLD = 0.5
#: A toxic string weighs by the power POWER of its support: the documents that hold it or strings like it, by the third
#: power of their kernel. So what stands in one document only, and is like nothing in others, hardly counts.
LIKE, POWER = 3, 2.5
#: How far the scores' scale makes up for the rarer class: 0 not at all, 1 in full.
BALANCE = 0.5
STEPS = [(a, b) for a in range(1, REACH) for b in range(1, REACH + 1 - a)]
#: Digits and signs that stand in for letters.
_LEET = str.maketrans("0134578@$", "oieastbas")
_JUNK = re.compile(r"[\W_\d]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\w)\w(?:[\W_]{1,2}\w(?!\w)){3,}")
_CODES: dict[str, int] = {}


def code(c: str) -> int:
    """a-z have their own codes, other letters share 36."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 36


def strings(text: str) -> dict[str, int]:
    """The strings of a text and how often each comes: folded tokens, in pieces where they are long, and spaced-out runs."""
    text = text.lower()
    raw = Counter(text.split())
    raw.update(m.group().replace(" ", "") for m in _SPACED.finditer(text))
    out: dict[str, int] = {}
    for token, n in raw.items():
        if not token.isalpha():
            token = _JUNK.sub("", token.strip(".,;:!?\"'()*#$%&|").translate(_LEET))
        if len(token) > LONGEST:
            for i in range(0, len(token) - OVERLAP, OVERLAP):
                piece = token[i : i + LONGEST]
                out[piece] = out.get(piece, 0) + n
        elif token:
            out[token] = out.get(token, 0) + n
    return out


def largest(margins: dict[str, float], counts: dict[str, int]) -> list[float]:
    """The TOP largest margins of a text's strings, as often as they come."""
    out: list[float] = []
    for m, n in heapq.nlargest(TOP, ((margins[s], n) for s, n in counts.items())):
        out += [m] * min(n, TOP - len(out))
    return out


def coded(words: list[str]) -> np.ndarray:
    """A row of codes for each word, with an edge on either side, padded."""
    width = max(map(len, words), default=0) + 2
    out = np.full((len(words), max(width, REACH + 1)), PAD, dtype=np.int32)
    for row, w in zip(out, words, strict=True):
        row[0] = row[len(w) + 1] = 0
        row[1 : len(w) + 1] = [_CODES.get(c) or _CODES.setdefault(c, code(c)) for c in w]
    return out


_NONE = LETTERS**3 - 1
#: Weight by letters skipped; the last one is for what touches padding.
_WEIGHTS = np.array([DECAY**k for k in range(REACH - 1)] + [0.0] * (8 - REACH + 1), dtype=np.float32)


def subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every subsequence of each row its index and weight; those that touch padding have index _NONE and no weight."""
    index, skipped = [], []
    for a, b in STEPS:
        x, y, z = codes[:, : -(a + b)], codes[:, a : codes.shape[1] - b], codes[:, a + b :]
        index.append(np.where(z == PAD, _NONE, (x * LETTERS + y) * LETTERS + z))
        skipped.append(np.full(index[-1].shape, a + b - 2, dtype=np.int32))
    found = np.concatenate(index, axis=1)
    return found, np.where(found == _NONE, 7, np.concatenate(skipped, axis=1))


def norms(index: np.ndarray, skipped: np.ndarray) -> np.ndarray:
    """The kernel's norm of each row: what falls on one subsequence adds up before it is squared."""
    key = np.sort(index * 8 + skipped, axis=1)
    index = key >> 3
    last = np.ones(key.shape, dtype=bool)
    last[:, :-1] = index[:, 1:] != index[:, :-1]
    ends = np.flatnonzero(last)
    sums = np.diff(np.cumsum(_WEIGHTS[key & 7].ravel(), dtype=np.float64)[ends], prepend=0.0)
    return np.sqrt(np.bincount(ends // key.shape[1], sums**2, minlength=len(key)) + 1e-9)


def lookup(words: list[str], table: np.ndarray, slot: np.ndarray | None = None) -> np.ndarray:
    """Sum of table rows over the words' subsequences, divided by their norms; in blocks of like length. slot: their rows."""
    out = np.zeros((len(words), *table.shape[1:]), dtype=np.float32)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    block = 2048 if table.ndim == 1 else 64
    for at in range(0, len(order), block):
        rows = order[at : at + block]
        index, skipped = subsequences(coded([words[i] for i in rows]))
        weight = _WEIGHTS[skipped]
        norm = norms(index, skipped)
        if table.ndim == 1:
            out[rows] = (table[index] * weight).sum(axis=1) / norm
        else:
            for k, i in enumerate(rows):
                out[i] = weight[k] @ table[slot[index[k]]] / norm[k]
    return out


@dataclass(frozen=True)
class KernelMachine:
    """weights over subsequences (the last one, of padding, is 0); a string's margin is their sum plus bias.

    mix and shift map a document's TOP largest margins to its score.
    """

    weights: np.ndarray
    bias: float
    mix: tuple[float, ...] = (3.0, 0.5, 0.5)
    shift: float = 0.0
    clip: bool = True

    def margins(self, words: list[str]) -> np.ndarray:
        found = lookup(words, self.weights) + self.bias
        return np.clip(found, LEAST, -LEAST) if self.clip else found


def train(positive: dict[str, float], negative: list[str], landmarks: list[str], penalty: float = PENALTY) -> KernelMachine:
    """Squared-hinge machine over the Nyström features of the landmarks, classes of equal weight; positive: strings and their documents."""
    landmarks = list(dict.fromkeys(landmarks))
    index, skipped = subsequences(coded(landmarks))
    seen = np.unique(index)
    seen = seen[seen != _NONE]
    slot = np.zeros(LETTERS**3, dtype=np.int32)
    slot[seen] = np.arange(1, len(seen) + 1)
    phi = np.zeros((len(seen) + 1, len(landmarks)), dtype=np.float32)
    for j, row in enumerate(slot[index]):
        np.add.at(phi[:, j], row, _WEIGHTS[skipped[j]])
    phi[0] = 0
    phi /= norms(index, skipped)
    value, vector = np.linalg.eigh((phi.T @ phi).astype(np.float64))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # kernel rows times root are the Nyström features
    words = [*positive, *negative]
    kernel = lookup(words, phi, slot)
    weight = np.array([*positive.values()])
    told = [j for j, w in enumerate(landmarks) if w in positive]
    support = np.maximum(weight, kernel[: len(positive), told].astype(np.float64) ** LIKE @ np.array([positive[landmarks[j]] for j in told])) ** POWER
    x = np.c_[kernel @ root, np.ones(len(words))]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.r_[0.5 * support / support.sum(), np.full(len(negative), 0.5 / len(negative))]
    w = np.zeros(x.shape[1])
    ridge = penalty * np.r_[np.ones(x.shape[1] - 1), 1e-3]
    for _ in range(30):  # Newton steps on the active rows
        slack = 1 - y * (x @ w)
        on = slack > 0
        step = np.linalg.solve((x[on].T * c[on]) @ x[on] + np.diag(ridge), (x[on].T * c[on]) @ (y[on] * slack[on]) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    weights = np.zeros(LETTERS**3, dtype=np.float32)
    weights[seen] = (phi @ (root @ w[:-1]))[1:]
    return KernelMachine(weights, float(w[-1]))


# ---- Spark ------------------------------------------------------------------------------------------------


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, doc, sentence (hashes of the texts) and the strings of every sentence."""
    for b in slices(batches, 1):
        rows = []
        for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            doc = xxhash.xxh64_intdigest((text or "").encode("utf-8", "replace")) - (1 << 63)
            for x in dict.fromkeys(_SENTENCE.split(text or "")):
                if found := strings(x):
                    rows.append((label, doc, xxhash.xxh64_intdigest(x.strip().encode("utf-8", "replace")) - (1 << 63), sorted(found)))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["label", "doc", "sentence", "strings"])


def _scorer(machine, text_at: int, name: str, most: int = 150_000):
    """Adds the largest margins of each text; a worker remembers a bounded number of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for b in slices(batches, text_at):
            texts = [strings(t or "") for t in b.column(text_at).to_pylist()]
            new = list(set().union(*texts) - known.keys())
            if len(known) + len(new) > most:
                known = {}
                new = list(set().union(*texts))
            known.update(zip(new, machine.value.margins(new).tolist(), strict=True))
            top = [largest(known, s) for s in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(top, pa.list_(pa.float64()))], names=[*b.schema.names, name])

    return run


def with_margins(docs: DataFrame, machine: KernelMachine, name: str = "_margins") -> DataFrame:
    """docs and one more column: the TOP largest margins of the text's strings, fewer if it has fewer.

    A column of docs with that name is replaced.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a table of fixed size
    docs = docs.drop(name).withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(_scorer(shared, docs.columns.index("text"), name), T.StructType([*docs.schema, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def labelled_sample(docs: DataFrame, labels: DataFrame, most_docs: int) -> DataFrame:
    """label and text of at most most_docs documents of either class, those first by hash of id; each text once."""
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1)).distinct()
    present = taught.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")
    of = lambda k: present.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
    chosen = F.broadcast(of(0).unionByName(of(1)))  # at most 2 * most_docs rows
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("label", "text").distinct()


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = 4000, most_strings: int = 12000, landmarks: int = 512) -> KernelMachine | None:
    """The machine; None where a class has no labelled document or no string sets toxic documents apart."""
    ship(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, most_docs))
    classes = {r.label for r in sample.select("label").distinct().collect()}
    if classes != {0, 1}:
        return None
    for_scale = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    found = materialize(sample.filter(~for_scale).mapInArrow(_sentences, "label int, doc long, sentence long, strings array<string>"))
    bags = found.groupBy("sentence").agg(F.min("label").alias("label"), F.first("strings").alias("strings"))  # of both kinds of documents: clean
    counts = materialize(bags.select("label", F.explode("strings").alias("s")).groupBy("s").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") == 0).alias("clean")))
    of_doc = materialize(found.filter("label = 1").select("doc", F.explode("strings").alias("s")).distinct().join(counts.filter("toxic > 0 AND clean = 0").select("s"), "s"))
    fold = F.pmod("doc", F.lit(2))

    def learnt(chosen: DataFrame, scored: DataFrame, worst: Column) -> KernelMachine | None:
        """Of strings of toxic documents (s, n: documents) against the worst and other strings of clean ones."""
        # TOP strings for each sampled toxic document at most, or most_strings
        positive = {r.s: float(r.n) for r in chosen.orderBy(F.desc("n"), F.xxhash64("s")).limit(most_strings).collect()}
        clean = scored.filter("clean > 0").select("s", worst.alias("w"))
        hard = [r.s for r in clean.orderBy(F.desc("w"), "s").limit(most_strings // 2).select("s").collect()]
        usual = [r.s for r in clean.orderBy(F.xxhash64("s"), "s").limit(most_strings // 2).select("s").collect()]
        if not positive or not usual:
            return None
        every = lambda x, n: x[:: max(1, len(x) // max(n, 1))][:n]
        known = list(positive)
        spread = known[: landmarks // 4] + every(known[landmarks // 4 :], landmarks // 4) + every(hard, landmarks // 4) + every(usual, landmarks // 4)
        return train(positive, sorted({*hard, *usual} - set(positive)), spread)

    scored = materialize(_scored(counts, [_mean_difference(counts)]))
    ranked = of_doc.join(scored, "s").withColumn("rank", F.row_number().over(W.partitionBy("doc").orderBy(F.desc(F.get("margins", F.lit(0))), "s")))
    worst = materialize(ranked.filter(F.col("rank") <= TOP).groupBy("s", fold.alias("fold")).agg(F.count("*").alias("n")))
    halves = [learnt(worst.filter(F.col("fold") == k), scored, F.get("margins", F.lit(0))) for k in (0, 1)]
    machine = next((h for h in halves if h), None)
    if all(halves):
        both = materialize(_scored(counts, halves))
        told = of_doc.join(both, "s").filter(F.get("margins", (1 - fold).cast("int")) >= TOLD).groupBy("s").agg(F.count("*").alias("n"))
        machine = learnt(told, both, F.array_max("margins")) or machine
        release(both)
    release(scored, worst)
    if machine is None:
        return None
    held = sample.filter(for_scale)
    machine = _calibrated(machine, held if held.groupBy("label").count().count() == 2 else sample)
    release(sample, found, counts, of_doc)
    return machine


def _mean_difference(counts: DataFrame) -> KernelMachine:
    """The first machine: how much more of a subsequence there is in toxic sentences than in clean ones, in standard errors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, LETTERS**3))
        for b in batches:
            words, n = b.column(0).to_pylist(), np.array([b.column(k).to_numpy() for k in (1, 2)], dtype=np.float64)
            order = sorted(range(len(words)), key=lambda i: len(words[i]))
            for at in range(0, len(order), 2048):
                rows = order[at : at + 2048]
                index, skipped = subsequences(coded([words[i] for i in rows]))
                for k in (0, 1):
                    total[k] += np.bincount(index.ravel(), (_WEIGHTS[skipped] * n[k][rows][:, None]).ravel(), minlength=LETTERS**3)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0][seen]), pa.array(total[1][seen])], names=["i", "toxic", "clean"])

    rows = counts.select("s", "toxic", "clean").mapInArrow(sums, "i long, toxic double, clean double").groupBy("i").agg(F.sum("toxic"), F.sum("clean")).toArrow()  # at most LETTERS ** 3 rows
    index, toxic, clean = (rows.column(k).to_numpy() for k in range(3))
    expected = clean * toxic.sum() / max(clean.sum(), 1e-9)
    weights = np.zeros(LETTERS**3, dtype=np.float32)
    weights[index] = (toxic - expected) / np.sqrt(expected + 1)
    weights[_NONE] = 0
    return KernelMachine(weights, 0.0, clip=False)


def _scored(counts: DataFrame, machines: list[KernelMachine]) -> DataFrame:
    """counts and margins, one of each machine."""
    shared = counts.sparkSession.sparkContext.broadcast(machines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            margins = np.array([m.margins(words) for m in shared.value]).T.tolist() if words else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(margins, pa.list_(pa.float32()))], names=["s", "toxic", "clean", "margins"])

    return counts.select("s", "toxic", "clean").mapInArrow(run, "s string, toxic long, clean long, margins array<float>")


def _calibrated(machine: KernelMachine, sample: DataFrame) -> KernelMachine:
    """mix and shift by logistic regression of the sampled documents' labels on their largest margins."""
    found = with_margins(sample, machine).select("label", "_margins").collect()  # of a sample of bounded size
    x = np.array([[*r._margins, *[LEAST] * (TOP - len(r._margins)), 1.0] for r in found])
    y = np.array([float(r.label) for r in found])
    weight = np.where(y > 0, (len(y) / max(y.sum(), 1)) ** BALANCE, 1.0)
    ridge = np.array([*[0.2] * TOP, 0.0])
    t = np.array([*machine.mix, machine.shift])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-6)) @ x + np.diag(ridge + 1e-9), x.T @ (weight * (y - p)) - ridge * t)
        t = t + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return KernelMachine(machine.weights, machine.bias, tuple(map(float, t[:TOP])), float(t[TOP]))


def score(margins: Column, machine: KernelMachine | None) -> Column:
    """0 to 1; 0 for a text without strings, and where there is no machine."""
    if machine is None:
        return F.lit(0.0)
    z = F.lit(machine.shift)
    for k, m in enumerate(machine.mix):
        z = z + m * F.coalesce(F.get(margins, F.lit(k)), F.lit(LEAST))
    return F.when(F.size(margins) > 0, 1 / (1 + F.exp(-z))).otherwise(0.0)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text).

    labels (doc_id, toxic) teach only by rows that aren't held out. Null and empty texts score 0; repeated
    rows score alike; a null id is scored too. Other columns don't matter, whatever their names; an empty table
    gives none; where nothing can be learnt every score is 0.
    """
    machine = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = with_margins(rows, machine) if machine else rows.withColumn("_margins", F.lit(None))
    out = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("_margins"), machine).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose texts score below the threshold, with all their columns; all rows where nothing can be learnt."""
    machine = fit(docs, labels)
    if machine is None:
        return docs
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"))
    kept = with_margins(rows, machine).filter(score(F.col("_margins"), machine) < threshold)
    return kept.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
