"""Extra columns with clashing names, nulls, empty tables, hot groups, long texts, and the whole pipeline."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright.llm import common, exact_dedup, html_extract, jaccard_join, line_dedup, packing, piece_encode, quality_model, quality_rules, secrets, toxicity

from .conftest import SCHEMA, words

ZERO = secrets.MarkovRatio((0,) * len(secrets.ALPHABET) ** 2)
#: Names that operators use for columns of their own.
CLASHES = ("spans", "base_spans", "n_assign", "n_hex", "ids", "decoded", "n_removed", "_row", "_docs_row", "_text", "_margins", "_done", "_gone", "_key", "_part", "_code", "kept", "path", "a.b")


@pytest.fixture(scope="module")
def crowded(docs):
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    return docs


def owned(df):
    """Whether every column of the caller's is as it was."""
    return all(df.filter(~F.col(f"`{c}`").eqNullSafe(F.lit(f"own {c}"))).count() == 0 for c in CLASHES)


def test_redaction_keeps_clashing_columns(crowded):
    out = secrets.redact(crowded, ZERO)
    assert out.columns == crowded.columns and out.count() == crowded.count() and owned(out)


def test_toxic_filter_keeps_clashing_columns(spark, crowded):
    labels = crowded.select("doc_id", F.lit(0).alias("quality"), F.col("text").contains("token").cast("int").alias("toxic"))
    out = toxicity.without_toxic(crowded, labels)
    assert out.columns == crowded.columns and owned(out)


def test_other_operators_stand_clashing_columns(crowded, docs):
    named = crowded.withColumns({c: F.lit(f"own {c}") for c in ("key", "gone", "hash", "c0", "c1", "doc id")})
    out = line_dedup.with_text_left(named)
    assert out.columns == named.columns and owned(out) and out.filter("key <> 'own key' OR gone <> 'own gone' OR c0 <> 'own c0'").count() == 0
    assert jaccard_join.one_of_each_group(crowded).count() == jaccard_join.one_of_each_group(docs).count()
    for make in (quality_rules.quality_rules, exact_dedup.exact_dedup, packing.packing_report, piece_encode.round_trips, secrets.secret_report):
        assert make(crowded).count() == make(docs).count()
    coded = piece_encode.decode_documents(piece_encode.encode_documents(crowded))
    assert coded.filter("decoded = coalesce(text, '')").count() == docs.count()


def test_pages_without_html_or_rows(spark):
    schema = "page_id long, url string, html string"
    assert html_extract.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    got = html_extract.extract_main_text(spark.createDataFrame([(None, None, None), (1, None, ""), (1, None, "")], schema)).collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0)] * 3


def test_models_score_null_rows(spark, nulls, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert len(quality_model.quality_scores(docs.unionByName(nulls), labels).filter("score IS NULL").collect()) == 0
    assert len(toxicity.toxicity_scores(docs.unionByName(nulls), labels).filter("score IS NULL").collect()) == 0


@pytest.mark.parametrize("piece", ["<a ", "<a '>'", "<a x='>", "<div>", "<!", "<", "<script></script ", "<div>x", "&#", "<p>x"])
def test_parsing_takes_time_in_proportion(piece):
    start = time.process_time()
    html_extract.best_container(html_extract.parse(piece * (1_000_000 // len(piece))))
    assert time.process_time() - start < 10


def test_votes_win_per_host(spark):
    body = "".join(f"<p>A long paragraph {k} with running text in it.</p>" for k in range(8))
    page = lambda box, extra="": f"<html><body><div class='{box}'>{body}</div>{extra}</body></html>"
    rows = [(i, "http://h.example/x", page("story")) for i in range(3)] + [(9, "http://h.example/y", page("other")), (10, "http://g.example/y", page("other"))]
    parsed = spark.createDataFrame(rows, "page_id long, url string, html string").mapInArrow(html_extract._parse_all, html_extract._PARSED).withColumn("host", html_extract.host(F.col("url")))
    own = {}
    for r in parsed.collect():
        own.setdefault(r.host, []).append(r.own_path)
    want = {h: max(sorted(set(x)), key=lambda p, x=x: (x.count(p), p)) for h, x in own.items()}
    assert {r.host: r.path for r in html_extract.winning_paths(parsed).collect()} == want


def test_groups_get_fences_of_their_own(spark):
    rng = random.Random(4)

    def text(busy):
        lines = [words(rng, 6, "abcdefghijklmnopqrst" if busy else "aeio") for _ in range(12)]
        if busy:
            lines = [x + " #$%" * rng.randint(1, 4) for x in lines]
            for k in range(rng.randint(2, 6)):
                lines[-1 - k] = lines[k]
        return "\n".join(lines)

    rows = [(i, text(i % 2), "en", ("calm", "busy")[i % 2], 0) for i in range(2400)]
    stats = quality_rules.document_stats(spark.createDataFrame(rows, SCHEMA).repartition(4))
    found = {r.source: r for r in quality_rules.adaptive_thresholds(stats).collect()}
    for m in quality_rules.MEASURES:
        assert found["calm"][f"high_{m}"] != found["busy"][f"high_{m}"], m
    assert all(found["calm"][f"high_{m}"] < found["busy"][f"high_{m}"] for m in ("symbols", "dup_lines", "repeats"))


def test_small_groups_lean_on_their_language(spark):
    rows = [("en", "big", "symbols", 0, 1000), ("en", "small", "symbols", 512, 1)]
    leaves = spark.createDataFrame(rows, "lang string, source string, measure string, low long, n long")
    lang = quality_rules.shrunk(quality_rules.merge(leaves, ["lang"]), quality_rules.merge(leaves, []), ["lang"], [])
    got = {r.source: r.high_symbols for r in quality_rules.fences(quality_rules.shrunk(leaves, lang, ["lang", "source"], ["lang"]), ["lang", "source"]).collect()}
    assert got == {"big": 0, "small": 0}


def test_hot_groups_are_joined_whole(spark):
    rows = spark.range(9000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 10)
    got = common.hot_join(rows, groups, ["k"], "n", 9000)
    assert got.count() == 9000 and got.select("id").distinct().count() == 9000 and got.filter("v <> k * 10").count() == 0


def test_slices_hold_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["a" * n if n % 3 else None for n in range(50)]), pa.array(range(50))], names=["t", "i"])
    got = list(common.slices(iter([b]), 0, 100))
    assert [x for s in got for x in s.column(1).to_pylist()] == list(range(50)) and len(got) > 5


def test_sequences_hardly_depend_on_the_files(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, words(rng, rng.randint(1, 120))) for i in range(600)], "doc_id long, text string")
    counts = []
    for n in (1, 24):
        got = packing.pack_documents(docs.repartition(n), capacity=256).toPandas()
        counts.append(got.sequence_id.nunique())
        assert got.groupby("sequence_id").length.sum().max() <= 256
    total = got.length.sum()
    assert max(counts) <= 1.02 * -(-total // 256) + 1


def test_long_words_go_the_same_way():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_encode.default_model_path())
    coder = piece_encode.PieceCoder(piece_encode.default_model_path(), at_once=500)
    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefgh-=é", k=n)) for n in (199, 201, 3000)] + ["ab" * 2000, "a" * 5000]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [model.encode(x) for x in texts]


@pytest.fixture(scope="module")
def secret_model(spark):
    vocabulary = "customer account balance transfer history service request handler response network printer station library article morning evening".split()
    samples = secrets.identifiers_of(spark.createDataFrame([(a + b,) for a in vocabulary for b in ("", "s", "ing", "ed", "er", "al", "ly", "ion", "able", "ment", "ness", "less")], "word string"))
    return secrets.fit(samples.unionByName(secrets.generated_samples(spark, 400)).unionByName(secrets.rules(spark)))


def test_identifiers_with_digits_are_ordinary_and_random_strings_are_not(spark, secret_model):
    rng = random.Random(12)
    alphabets = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    random_ones = ["".join(rng.choices(a, k=n)) for a in alphabets for n in (16, 20, 32) for _ in range(25)]
    ordinary = ["customer_account_v2_2024", "getHttpResponseStatusCode404Handler", "MAX_ACCOUNT_COUNT_V2", "account-service-linux-1-2-3", "==============", "history/2019/request404", "station_2024-01-15", "20240115-103045-88"]
    rows = [(v, True) for v in random_ones] + [(v, False) for v in ordinary]
    got = spark.createDataFrame(rows, "v string, truth boolean").select("v", "truth", secret_model.is_random(F.col("v")).alias("r")).collect()
    assert not [r.v for r in got if not r.truth and r.r]
    assert sum(r.r for r in got if r.truth) >= 0.95 * len(random_ones)


def brute_spans(text, model):
    """The models' spans by plain Python: whole runs of 12 characters on, apart from base spans."""
    import re

    from .test_text_operators import base_spans

    n, base = len(secrets.ALPHABET), base_spans(text)
    tables = np.array(model.weights).reshape(-1, n, n)
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        codes = [secrets.ALPHABET.index(c) for c in m[0]]
        best = max(int(sum(t[a, b] for a, b in zip(codes, codes[1:], strict=False))) for t in tables) / 1000 - np.log(len(tables))
        if len(m[0]) >= 12 and best >= model.least and not any(s < m.end() and e > m.start() for s, _, e in base):
            out.append((m.start(), 3, m.end()))
    return sorted(base + out)


def test_all_spans_match_plain_python(spark, docs, rows, secret_model):
    extra = [(500, "a xK8pQ2mN7vR4tY9w é 😀 customer_account_v2 zqxjvkwpfhgbt, qwrtpsdfghjklzxcv=ab", "en", "s", 0)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs.unionByName(spark.createDataFrame(extra, SCHEMA)), secret_model).collect()}
    for i, t, *_ in [*rows, *extra]:
        assert [(s.start, s.kind, s.end) for s in got[i].spans] == brute_spans(t or "", secret_model), i
    assert any(s.kind == 3 for s in got[500].spans)


# ---- the pipeline -----------------------------------------------------------------------------------------


def write_tables(spark, path, docs, labels):
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{path}/labels.parquet")


def test_pipeline_keeps_what_is_clean(spark, docs, crowded, tmp_path):
    import corpus_pipeline

    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).distinct()
    names = [c for c in crowded.columns if c not in ("a.b", "n_removed", "_gone", "_key")]
    write_tables(spark, str(tmp_path), crowded.select(*(F.col(f"`{c}`") for c in names)), labels)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    after = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.materialize(stage(spark, after, str(tmp_path)))
        assert after.columns == docs.columns, name
    assert sorted(set(got.doc_id)) == sorted({r.doc_id for r in after.select("doc_id").collect()})
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY
    kept = {r.doc_id: r.text for r in after.collect()}
    assert all("269b1cea0846965f" not in (t or "") for t in kept.values())


def test_pipeline_of_empty_and_null_tables(spark, empty, nulls, tmp_path):
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs, n in (("empty", empty, 0), ("nulls", nulls, 2)):
        write_tables(spark, str(tmp_path / name), docs, none)
        assert corpus_pipeline.run(spark, str(tmp_path / name)).select("doc_id").distinct().count() <= max(n, 0)


def test_secret_chains_learn_from_every_document(spark):
    """25,000 documents with a word of their own each: every word is in the samples."""
    n = 25_000
    docs = spark.range(n).select(F.concat(F.lit("w"), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij")).alias("text"))
    assert secrets.corpus_samples(docs).count() == n
