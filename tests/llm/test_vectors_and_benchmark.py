import hashlib
import math
import random
import re

import numpy as np
import pytest

from pairwright.llm import decontaminate as D
from pairwright.llm.hard_negatives import hard_negatives, spanning_tree
from pairwright.llm.vector_codes import _advance, _anew, _roots, code_report, encode_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n, seed=1, dim=16):
    """Few labels of which one is hot, repeated rows and vectors, unusable ones, and some null ids and labels."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = 0 if rng.random() < 0.4 else rng.randint(1, 9)
        v = [float(np.float32(rng.gauss(label / 20, 0.3))) for _ in range(dim)]
        rows.append((i, v, label))
    rows += [rows[0], rows[100], (n, rows[3][1], 4), (n + 1, rows[3][1], None), (None, rows[5][1], 2), (n + 2, None, 1), (n + 3, [1.0, None] * (dim // 2), 1), (n + 4, [math.nan] * dim, 2), (n + 5, [math.inf] * dim, 2)]
    rng.shuffle(rows)
    return rows


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def whole(rows, scale):
    return np.floor(np.array([r[1] for r in rows], np.float64) * scale).astype(np.int64)


def codes_by_force(rows):
    rows = usable(rows)
    x = whole(rows, 1024)
    parts = x.reshape(len(x), 4, -1)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))[:256]
    books = parts[first].transpose(1, 0, 2).copy()
    near = lambda: np.stack([((parts[:, p, None] - books[p]) ** 2).sum(2).argmin(1) for p in range(4)], 1)
    for _ in range(4):
        of = near()
        for p in range(4):
            for k in set(of[:, p].tolist()):
                books[p, k] = parts[of[:, p] == k, p].sum(0) // (of[:, p] == k).sum()
    of = near()
    errors = sum(((parts[:, p] - books[p][of[:, p]]) ** 2).sum(1) for p in range(4)).tolist()
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], bytes(c.tolist()).hex(), e, by_label[r[2]], digest) for r, c, e in zip(rows, of, errors, strict=True)), key=repr)


@pytest.mark.parametrize("n", [120, 700])
def test_codes_equal_those_of_all_distances(spark, n):
    rows = vectors(n)
    got = code_report(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == codes_by_force(rows)


def test_codes_of_ties_short_vectors_and_no_rows(spark):
    same = [(i, [0.5] * 8, 1) for i in range(20)]
    assert {r["code"] for r in code_report(spark.createDataFrame(same, SCHEMA)).collect()} == {"00000000"}
    ragged, books = encode_vectors(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [1e30] * 5, None)], SCHEMA))
    assert books.shape == (4, 3, 2) and sorted(r["error"] for r in ragged.collect()) == [0, 0, 0]
    none = code_report(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0


def test_codes_ignore_other_columns(spark):
    rows = vectors(120)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", "1 AS code", "2 AS error", "'x' AS state", "3 AS _n", "'y' AS vector")
    assert sorted(map(tuple, code_report(more).collect()), key=repr) == sorted(map(tuple, code_report(df).collect()), key=repr)


def test_bounds_hold_through_rounds():
    """The own entry is always the nearest, and lower bounds never exceed distances."""
    rng = np.random.default_rng(3)
    x, book = rng.integers(-50, 50, (400, 4)), rng.integers(-50, 50, (40, 4))
    state, b = _anew(x, book, 10, np.float64), 10
    for round_, shorter in enumerate((10, 8, 5, 5)):
        moved = book + rng.integers(-3 - round_, 4 + round_, book.shape)
        state, depth = _advance(x, moved, _roots(((moved - book) ** 2).sum(1))[1], state, shorter, np.float64)
        book, b = moved, shorter
        far = ((x[:, None] - book) ** 2).sum(2)
        assert (state["own"] == far.argmin(1)).all()
        true = np.sqrt(far)
        assert (state["lower"] <= np.take_along_axis(true, state["listed"].astype(int), 1) + 1e-9).all()
        others = true.copy()
        np.put_along_axis(others, np.concatenate([state["own"][:, None], state["listed"]], 1).astype(int), np.inf, 1)
        assert (state["outer"] <= others.min(1) + 1e-9).all() and (state["upper"] >= true[np.arange(400), state["own"]] - 1e-6).all()
        assert depth.max() <= b + 1


def negatives_by_force(rows):
    rows = [r for r in usable(rows) if r[2] is not None]
    x = whole(rows, 256)
    label = [(r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2] for r in rows]
    out = []
    for a, row in enumerate(rows):
        if row[0] is None or row[0] % 100:
            continue
        scores = (x @ x[a]).tolist()
        order = sorted((i for i in range(len(rows)) if i != a), key=lambda i: (-scores[i], rows[i][0] is None, rows[i][0] or 0))
        for p in [i for i in order if label[i] == label[a]][:5]:
            hard = [i for i in order if label[i] != label[a] and 80 * scores[p] <= 100 * scores[i] <= 100 * scores[p]][:5]
            out += [(row[0], rows[p][0], k, rows[i][0], scores[p], scores[i]) for k, i in enumerate(hard, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [16_384, 3])
def test_negatives_equal_those_of_all_scores(spark, block):
    rows = vectors(900, seed=5)
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == negatives_by_force(rows)


def test_negatives_of_edge_cases(spark):
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hard_negatives(spark.createDataFrame([(100, [1.0], None), (None, [1.0], 1), (200, [], 3)], SCHEMA)).count() == 0
    ties = [(i, [1.0, 0.0], i % 2) for i in range(0, 240)]
    got = hard_negatives(spark.createDataFrame(ties, SCHEMA).selectExpr("*", "5 AS rank", "6 AS score", "'z' AS anchor"))
    assert sorted(map(tuple, got.collect()), key=repr) == negatives_by_force(ties)


def test_spanning_tree_is_least():
    x = np.random.default_rng(2).normal(size=(40, 3))
    order, parent, edge = spanning_tree(x)
    assert sorted(order.tolist()) == list(range(40)) and parent[0] == -1 and all(parent[i] < i for i in range(40))
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    in_tree, total = {0}, 0.0
    while len(in_tree) < 40:  # plain Prim
        d, j = min((far[i, j], j) for i in in_tree for j in range(40) if j not in in_tree)
        total, in_tree = total + d, in_tree | {j}
    assert math.isclose(edge.sum(), total, rel_tol=1e-6)


# ---- benchmark passages -------------------------------------------------------------------------------------

DOCS = "doc_id long, text string"
BENCH = "item_id long, text string"


def words_by_force(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_by_force(docs, bench):
    grams = {}
    for item, text in bench:
        w = words_by_force(text)
        for at in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[at : at + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, items = words_by_force(text), set(), set()
        for at in range(len(w)):
            for n in range(1, 11):
                if at + n <= len(w) and tuple(w[at : at + n]) in grams:
                    hit |= set(range(at, at + n))
                    items |= grams[tuple(w[at : at + n])]
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus(seed=4):
    rng = random.Random(seed)
    draw = lambda n: " ".join(rng.choice(["Ab", "c", "été", "DÉ", "x1", "日本", "no"]) + rng.choice(["", str(rng.randint(0, 30))]) for _ in range(n))
    bench = [(i, draw(rng.randint(11, 40))) for i in range(30)] + [(30, "Ab c"), (31, "été"), (32, ""), (33, None), (33, draw(12)), (None, draw(15)), (5, draw(14))]
    docs = [(i, draw(rng.randint(0, 300))) for i in range(40)]
    for i in range(40, 80):
        passage = bench[rng.randrange(len(bench))][1] or ""
        docs.append((i, f"{draw(rng.randint(0, 40))}, {passage.upper() if i % 2 else passage.replace(' ', ' - ')}\n{draw(rng.randint(0, 40))} {passage}"))
    docs += [(90, None), (91, ""), (None, bench[0][1]), (92, "Ab c" * 3), docs[45], docs[45], (93, "?!"), (94, "no " * 5000)]
    return docs, bench


def test_contamination_equals_a_plain_search(spark):
    docs, bench = corpus()
    got = D.contamination_report(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(bench, BENCH))
    assert sorted(map(tuple, got.collect()), key=repr) == contamination_by_force(docs, bench)


def test_contamination_in_blocks_and_small_shards(spark, monkeypatch):
    docs, bench = corpus(6)
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, BENCH)
    every = ["doc_id", "n_words", "n_hit", "word_spans", "spans", "items"]
    one = D.contamination(d, b).select(every).collect()
    many = D.contamination(d, b, block_windows=50).select(every).collect()
    assert sorted(one, key=repr) == sorted(many, key=repr)


def test_passages_go_and_other_columns_stay(spark):
    bench = [(1, "one two three four five six seven eight nine ten eleven")]
    docs = [(1, "Été: One two, three four five six seven eight nine ten ELEVEN! End.", "a", 5), (2, "nothing here", None, 12), (3, None, "c", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, `items` string, n_chars int")
    out = {r["doc_id"]: r for r in D.decontaminate(d.withColumnRenamed("items", "we.ird"), spark.createDataFrame(bench, BENCH)).collect()}
    assert out[1]["text"] == "Été: ! End." and out[1]["n_chars"] == 11 and out[1]["we.ird"] == "a"
    assert out[2]["text"] == "nothing here" and out[2]["n_chars"] == 12 and out[3]["text"] is None
    nothing = D.decontaminate(d, spark.createDataFrame([], BENCH)).select("text").collect()
    assert sorted((r[0] or "" for r in nothing)) == sorted(t or "" for _, t, _, _ in docs)
    assert D.contamination_report(spark.createDataFrame([], DOCS), spark.createDataFrame(bench, BENCH)).count() == 0


def test_suffix_array_and_index_against_sorting():
    rng = np.random.default_rng(1)
    for symbols, n in ((1, 50), (2, 300), (40, 500)):
        s = np.append(rng.integers(1, symbols + 1, n), 0)
        s[-1] = symbols + 1
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert D.suffix_array(s, symbols + 2).tolist() == want
    ids, counts = rng.integers(0, 5, 600), np.array([200, 0, 1, 399])
    index = D.FMIndex(ids, counts, 5)
    for n in (1, 2, 4):
        phrases = rng.integers(0, 5, (60, n))
        which, low, high = index.search(phrases, np.full(60, n))
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
        texts, starts = np.split(ids, np.cumsum(counts)[:-1]), index.starts
        for k, phrase in enumerate(phrases):
            want = [int(starts[t]) + i for t, text in enumerate(texts) for i in range(len(text) - n + 1) if (text[i : i + n] == phrase).all()]
            assert found.get(k, []) == want
