"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Everything runs as DataFrame expressions. Positions come from what a pattern leaves between its matches:
the pieces of split() and the matches of regexp_extract_all() alternate, so running sums of their lengths
are the offsets, in code points. First-order Markov chains over the characters of a candidate, one for each
alphabet of random strings and one of ordinary identifiers, give its log-likelihood ratio, the best random
chain against the ordinary one; candidates past the threshold become spans of kind `markov` where they don't
touch a span of a fixed pattern. The chains are trained from labelled samples: generated random strings, the
values that the fixed patterns caught in the corpus, and identifiers: the corpus's own long words, and each
of its words put together with usual parts, versions, dates and numbers.
"""

from __future__ import annotations

import json
import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import materialize

#: The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are long enough: as a match takes a whole run, shorter ones can't hide a longer one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED = 12
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
_RUN = "[A-Za-z0-9+/_=-]"
#: A whole run of characters that tokens are made of.
CANDIDATE = rf"(?<!{_RUN}){_RUN}{{12,}}"
IDENTIFIER = rf"(?<!{_RUN})[A-Za-z_-]{{12,}}(?!{_RUN})"
WORD = r"[A-Za-z]{3,}"
#: Usual parts of identifiers, which stand beside the corpus's words in labelled samples.
PARTS = (
    "get", "set", "is", "has", "to", "from", "by", "of", "id", "name", "type", "key", "value", "list", "map", "count", "size", "max", "min", "index", "user", "account", "order", "file", "path", "url",
    "http", "api", "test", "data", "base", "model", "view", "handler", "manager", "service", "client", "server", "config", "status", "code", "error", "request", "response", "version", "date", "time", "host", "src", "lib",
    "abstract", "factory", "proxy", "builder", "string", "buffer", "stream", "queue", "thread", "cache", "session", "provider", "controller", "template", "util", "common", "core", "main", "app", "build", "linux", "node",
    "java", "python", "image", "profile", "picture", "group", "process", "function", "object", "event", "message", "package", "public", "private", "static", "default", "system", "network", "database", "backup",
)
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_BLOCK = 256


@dataclass(frozen=True)
class MarkovRatio:
    """weights[(k * N + a) * N + b], N = len(ALPHABET): thousandths of a nat that b after a speaks for random chain k.

    least: the log of how much rarer random strings are held to be than ordinary ones.
    """

    weights: tuple[int, ...]
    least: float = 10.0

    def ratio(self, value: Column) -> Column:
        """Of the random chain that fits best, in nats, with what the choice among them costs."""
        n = len(ALPHABET)
        chains = len(self.weights) // n**2
        codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        steps = F.zip_with(F.slice(codes, 1, F.length(value) - 1), F.slice(codes, 2, F.length(value) - 1), lambda a, b: a * n + b)
        tables = [F.from_json(F.lit(json.dumps(self.weights[k * n**2 : (k + 1) * n**2])), "array<int>") for k in range(chains)]

        def best(steps: Column) -> Column:
            sums = [F.aggregate(steps, F.lit(0), _adder(t)) for t in tables]
            return (F.greatest(*sums) if chains > 1 else sums[0]) / 1000.0 - float(np.log(chains))

        return F.get(F.transform(F.array(steps), best), F.lit(0))  # one evaluation of the steps for all chains

    def is_random(self, value: Column) -> Column:
        return self.ratio(value) >= self.least


def _adder(table: Column):
    return lambda acc, x: acc + F.coalesce(F.get(table, x), F.lit(0))


def _sums(lengths: Column) -> Column:
    none = F.expr("CAST(array() AS array<int>)")
    return F.aggregate(lengths, none, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))


def running_sums(lengths: Column) -> Column:
    """Running sums of a non-empty array, by blocks, so that a text with very many matches costs little more."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: _sums(F.slice(lengths, b * _BLOCK + 1, _BLOCK)))
    before = F.concat(F.array(F.lit(0)), _sums(F.transform(blocks, lambda b: F.element_at(b, -1))))
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, o: F.transform(b, lambda x: x + o)))


def with_matches(df: DataFrame, name: str, pattern: str, value_group: int = 0) -> DataFrame:
    """Adds column `name`: start, end and value of each leftmost non-overlapping match in _text."""
    hit, lit = F.col("_text").rlike(pattern), F.lit(pattern)
    df = df.withColumns({"_m": F.when(hit, F.regexp_extract_all("_text", lit, F.lit(0))), "_p": F.when(hit, F.split("_text", pattern, -1)), "_v": F.when(hit, F.regexp_extract_all("_text", lit, F.lit(value_group)))})
    df = df.withColumn("_e", F.when(F.size("_m") > 0, F.zip_with(F.slice("_p", 1, F.size("_m")), "_m", lambda p, m: F.length(p) + F.length(m))))
    df = df.withColumn("_e", F.when(F.col("_e").isNotNull(), running_sums(F.col("_e"))))
    found = F.transform(F.arrays_zip("_m", "_e", "_v"), lambda x: F.struct((x["_e"] - F.length(x["_m"])).alias("start"), x["_e"].alias("end"), x["_v"].alias("value")))
    return df.withColumn(name, F.coalesce(found, F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>"))).drop("_m", "_p", "_v", "_e")


def _spans(matches: Column, kind: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def base_matches(docs: DataFrame) -> DataFrame:
    """Adds _text (a null text is empty) and the matches of the fixed patterns as _assign, _access and _hex."""
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    df = with_matches(df, "_assign", ASSIGN, 2)
    df = df.withColumn("_assign", F.filter("_assign", lambda m: F.length(m["value"]) >= LEAST_ASSIGNED))
    return with_matches(with_matches(df, "_access", ACCESS), "_hex", HEX)


def find_secrets(docs: DataFrame, model: MarkovRatio) -> DataFrame:
    """docs (with a column text) and base_spans, spans: arrays of start, kind (index in KINDS), end, sorted.

    Offsets are code points, the end exclusive. base_spans has the fixed patterns' matches, which may
    overlap across kinds; spans adds those of the models; n_assign, n_access and n_hex count the former. A
    null or empty text has none; repeated rows have the same; an empty table gives none. Columns of docs with
    one of these five names are replaced, all others stay.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("text"))
    df = with_matches(base_matches(rows), "_run", CANDIDATE)
    base = F.array_sort(F.concat(*(_spans(F.col(f"_{k}"), k) for k in KINDS[:3])))
    df = df.withColumn("base_spans", base.cast(_SPAN))
    apart = lambda m: ~F.exists("base_spans", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"]))
    random = F.filter(F.filter("_run", apart), lambda m: model.is_random(m["value"]))
    found = {"base_spans": F.col("base_spans"), "spans": F.array_sort(F.concat("base_spans", _spans(random, "markov"))).cast(_SPAN), **{f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS[:3]}}
    return df.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in found), *(v.alias(k) for k, v in found.items()))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _running_max(values: Column) -> Column:
    """The greatest value before each one, 0 at first, by blocks as in running_sums."""
    top = lambda x, first: F.aggregate(x, F.array(first), lambda acc, v: F.array_append(acc, F.greatest(F.element_at(acc, -1), v)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int")), lambda b: F.slice(values, b * _BLOCK + 1, _BLOCK))
    before = top(F.transform(blocks, lambda b: F.array_max(b)), F.lit(0))
    return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)), lambda b, first: F.slice(top(b, first), 1, F.size(b))))


def redact(docs: DataFrame, model: MarkovRatio, mark: str = "[secret]") -> DataFrame:
    """docs with every span of their texts, overlapping ones together, replaced by a mark; n_chars follows.

    All columns stay, whatever their names; a text without spans, null or empty ones too, stays as it is.
    """
    rows = docs.select(F.struct("*").alias("_docs_row"), F.col("text").cast("string").alias("text"))
    df = find_secrets(rows, model).withColumn("_done", F.when(F.size("spans") > 0, _running_max(F.col("spans.end"))))
    piece = lambda s: F.when(s["spans"]["start"] >= s["_done"], F.concat(F.substring(F.col("text"), s["_done"] + 1, s["spans"]["start"] - s["_done"]), F.lit(mark))).otherwise("")
    last = F.array_max("spans.end")
    text = F.concat(F.array_join(F.transform(F.arrays_zip("spans", "_done"), piece), ""), F.substring(F.col("text"), last + 1, F.length("text")))
    df = df.withColumn("_text", F.when(F.size("spans") > 0, text))
    new = {"text": F.coalesce(F.col("_text"), F.col("_docs_row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_text").isNotNull(), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_docs_row")["n_chars"])
    return df.select(*(new.get(c, F.col("_docs_row")[c]).alias(c) for c in docs.columns))


# ---- training ----------------------------------------------------------------------------------------------


def generated_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled samples of random strings in the alphabets that tokens use: (label, value)."""
    i = F.col("id").cast("string")
    base64 = F.base64(F.unhex(F.sha2(i, 256)))
    letters = F.translate(base64, "0123456789+/=", "")
    short = F.conv(F.substring(F.sha2(i, 224), 1, 15), 16, 36)
    made = {
        "base64": base64, "url64": F.translate(F.base64(F.unhex(F.sha2(i, 384))), "+/", "-_"), "base62": F.translate(base64, "+/=", ""), "hex": F.lower(F.hex(F.md5(i))),
        "upper36": F.upper(short), "lower36": F.lower(short), "letters": letters, "lower": F.lower(letters), "upper": F.upper(letters),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in made.items()))
    return spark.range(n).select(F.explode(pairs).alias("s")).select("s.label", "s.value")


def rules(spark: SparkSession, n: int = 300) -> DataFrame:
    """Labelled samples of ruled lines, which are ordinary too."""
    length = (F.lit(12) + F.col("id") % 30).cast("int")
    return spark.range(n).select(F.lit("identifier").alias("label"), F.explode(F.array(*(F.repeat(F.lit(c), length) for c in "=-_+/x"))).alias("value"))


def identifiers_of(words: DataFrame) -> DataFrame:
    """Labelled samples (label, value): each word with usual parts, versions, dates and numbers, which ones its hash says."""
    w, h = F.lower("word"), F.xxhash64("word")
    digit = lambda shift, n: F.pmod(F.shiftright(h, shift), F.lit(n)).cast("int")
    part = lambda shift: F.element_at(F.array(*map(F.lit, PARTS)), digit(shift, len(PARTS)) + 1)
    number = lambda shift, n: digit(shift, n).cast("string")
    two = lambda shift, n: F.lpad((digit(shift, n) + 1).cast("string"), 2, "0")
    a, b, year = part(0), part(7), (F.lit(1990) + digit(13, 40)).cast("string")
    made = [
        F.concat_ws("_", w, a, b), F.concat_ws("_", a, w, F.concat(F.lit("v"), number(17, 9)), year), F.concat(a, F.initcap(w), number(19, 1000), F.initcap(b)), F.concat(F.initcap(w), F.initcap(a), F.initcap(b)),
        F.upper(F.concat_ws("_", a, b, w, F.concat(F.lit("V"), number(23, 20)))), F.concat_ws("-", w, a, number(29, 20), number(31, 20), number(37, 100)), F.concat_ws("/", a, w, year, F.concat(b, number(41, 100))),
        F.concat(w, F.lit("_"), year, F.lit("-"), two(43, 12), F.lit("-"), two(47, 28)), F.concat(a, number(5, 100), F.lit("_"), number(11, 100), F.lit("-"), w), F.concat(w, year, a, number(19, 100)),
        F.concat_ws("-", b, F.concat(year, two(43, 12), two(47, 28)), number(3, 1_000_000), number(9, 1_000_000_000)),
    ]
    return words.select(F.lit("identifier").alias("label"), F.element_at(F.array(*made), digit(53, len(made)) + 1).alias("value"))


def corpus_samples(docs: DataFrame) -> DataFrame:
    """Labelled samples of all documents, each once: values that the fixed patterns caught, and ordinary identifiers, which are long words and every word put together with other parts."""
    df = base_matches(docs.select(F.col("text").cast("string").alias("text")))
    labelled = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("label"), v.alias("value")))
    caught = labelled("caught", F.transform(F.concat("_assign", "_access", "_hex"), lambda m: m["value"]))
    plain = labelled("identifier", F.regexp_extract_all("_text", F.lit(IDENTIFIER), F.lit(0)))
    words = labelled("word", F.array_distinct(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))))
    found = materialize(df.select(F.explode(F.concat(caught, plain, words)).alias("s")).select("s.label", "s.value").distinct())
    return found.filter("label <> 'word'").unionByName(identifiers_of(found.filter("label = 'word'").select(F.col("value").alias("word"))))


def transition_counts(samples: DataFrame) -> dict[str, np.ndarray]:
    """For each label the counts of character b after a: tables of fixed size, whatever the samples are."""
    k = len(ALPHABET)
    codes = F.transform(F.split("value", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    steps = samples.withColumn("c", codes).select("label", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.when((a >= 0) & (b >= 0), a * k + b))).alias("pair"))
    counts: dict[str, np.ndarray] = {}
    for r in steps.filter("pair IS NOT NULL").groupBy("label", "pair").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.label, np.zeros(k * k))[r.pair] = r.n
    return {x: c.reshape(k, k) for x, c in sorted(counts.items())}


def fit(samples: DataFrame, smoothing: float = 0.5) -> MarkovRatio:
    """A chain for each label of random strings, against that of the label `identifier`."""
    k = len(ALPHABET)

    def chain(c: np.ndarray) -> np.ndarray:
        """Transition probabilities; rare contexts fall back on how frequent a character is at all."""
        single = (c.sum(axis=0) + smoothing) / (c.sum() + smoothing * k)
        return (c + smoothing * k * single) / (c.sum(axis=1, keepdims=True) + smoothing * k)

    counts = transition_counts(samples)
    plain = np.log(chain(counts.pop("identifier", np.zeros((k, k)))))
    random = [np.log(chain(c)) - plain for c in counts.values()] or [np.zeros((k, k))]
    return MarkovRatio(tuple(int(x) for x in np.rint(1000 * np.array(random)).ravel()))


def fit_corpus(docs: DataFrame) -> MarkovRatio:
    spark = docs.sparkSession
    return fit(corpus_samples(docs).unionByName(generated_samples(spark)).unionByName(rules(spark)))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs; other columns don't matter."""
    df = find_secrets(docs.select("doc_id", "text"), fit_corpus(docs))
    return df.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
