"""Operators on groups of documents against brute force, and classifiers on held-out rows."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairwright.llm import components as C
from pairwright.llm import exact_dedup, jaccard_join, quality_model, toxicity

from .conftest import SCHEMA, words


def groups_of(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, len(t or "")))
    return by


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_copies(docs, rows, fan_in):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, fan_in).collect()}
    for members in groups_of(rows).values():
        keep = min(members, key=lambda m: (-m[1], m[0]))[0]
        for i, _ in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (keep, len(members), i == keep)


def sets_of(rows):
    out = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def linked_components(sets):
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("block", [3, 1000])
def test_near_duplicates(docs, rows, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, block=block).collect()}
    sets = sets_of(rows)
    root = linked_components(sets)
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_near_duplicates_in_random_neighbourhoods(spark):
    rng = random.Random(3)
    rows = []
    for g in range(12):
        base = words(rng, rng.choice([4, 9, 40, 150])).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice("uvwxyz") * 3
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, 3)]), "en", "s", 0))
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), block=5).collect()}
    assert got == linked_components(sets_of(rows))


def test_one_document_of_each_group_stays(docs, rows):
    root = linked_components(sets_of(rows))
    assert {r.doc_id for r in jaccard_join.one_of_each_group(docs).collect()} == {i for i, c in root.items() if i == c}


def test_trie_finds_what_brute_force_finds():
    rng = random.Random(5)
    import numpy as np

    sets = [np.unique(np.array(rng.sample(range(60), rng.randint(1, 50)), dtype=np.uint64)) for _ in range(80)]
    sets += [np.unique(np.concatenate([s[1:], np.array([70], dtype=np.uint64)])) for s in sets[:40]]
    trie = jaccard_join.Trie(sets)
    for q in sets:
        want = {j for j, s in enumerate(sets) if jaccard_join.is_linked(len(np.intersect1d(q, s)), len(q), len(s))}
        assert set(trie.linked(q)) == want


def test_links_span_groups_of_any_size(spark):
    members = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 100), (2, 101)], "g long, doc long")
    data = members.select("doc").distinct().withColumn("x", F.col("doc"))

    def chain(table: pa.Table):  # neighbours within two are linked
        x = table.column("x").to_pylist()
        yield from ((i, j) for i in range(len(x)) for j in range(i) if abs(x[i] - x[j]) <= 2)

    got = {r.v: r.c for r in C.components(C.spanning_links(members, data, chain, 7)).collect()}
    assert got == {**{i: 0 for i in range(60)}, 100: 100, 101: 100}


@pytest.mark.parametrize("make", [exact_dedup.exact_dedup, jaccard_join.near_duplicates])
def test_empty_and_null_rows(make, empty, nulls):
    assert make(empty).count() == 0
    assert len(make(nulls).collect()) == 3


def labelled(spark, bad, n=240):
    rng = random.Random(11)
    rows = [(i, words(rng, 80, "etaoinshrd") + ".\n" + words(rng, 40, "etaoinshrd") + ".", "en", "s", 0) for i in range(n)]
    rows = [(i, bad(t, i) if i % 4 == 0 else t, *r) for i, t, *r in rows]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, SCHEMA), labels


def held_out_accuracy(scores, labels, name):
    rows = scores.join(labels, "doc_id").filter("held_out").select("predicted", name).collect()
    assert len(rows) > 20
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, lambda t, i: t.upper().replace(" ", "!! ") if i % 8 else t.replace(" ", "*** "))
    assert held_out_accuracy(quality_model.quality_scores(docs, labels), labels, "quality") > 0.95


INSULTS = ["blockhead", "numbskull", "gobshite", "wretch"]


def test_toxicity_on_held_out_rows_and_written_otherwise(spark):
    docs, labels = labelled(spark, lambda t, i: t.replace(" ", f" {INSULTS[i // 4 % 4]} ", 1 + i % 3))
    assert held_out_accuracy(toxicity.toxicity_scores(docs, labels), labels, "toxic") > 0.95
    machine = toxicity.fit(docs, labels)
    plain = "the tin hat is on the east road"
    cases = [(1, f"{plain} you blockxhead {plain}"), (2, f"{plain} n u m b s k u l l {plain}"), (3, plain), (4, "")]
    got = {r.doc_id: r.s for r in toxicity.with_margins(spark.createDataFrame(cases, "doc_id long, text string"), machine).select("doc_id", toxicity.score(F.col("_margins"), machine).alias("s")).collect()}
    assert got[1] > got[3] and got[2] > got[3] and got[4] == 0
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == {i for i in range(240) if i % 4}


def test_models_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.quality_scores(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    assert quality_model.quality_scores(empty, none).count() == toxicity.toxicity_scores(empty, none).count() == 0
