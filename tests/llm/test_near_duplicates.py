"""N-gram join and embedding links against all pairs."""

import math
import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from gaugeline.llm import embedding_dedup, links, ngram_join
from gaugeline.llm.queries import QUERIES


def _jaccard(a, b):
    return len(a & b) / len(a | b)


def _linked(texts, k=5, threshold=0.8):
    sets = [plain.grams(t, k) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and _jaccard(sets[i], sets[j]) >= threshold]


def _documents(seed, groups=25):
    draw = random.Random(seed)
    out = []
    for _ in range(groups):
        base = ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(draw.randint(3, 120))]
        for _ in range(draw.choice([1, 1, 2, 3, 6])):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                words[draw.randrange(len(words))] = draw.choice(["new", "other", "x"])
            out.append(" ".join(words))
    return [*out, None, "", " \n ", "one", "one", "two words", out[0], out[0]]


@pytest.mark.parametrize("block", [3, 512])
def test_join_equals_all_pairs(spark, block):
    texts = _documents(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: r for r in ngram_join.link(docs, rows=3, recall=0.999999, block=block).collect()}
    pairs = _linked(texts)
    want = plain.classes(len(texts), pairs)
    degree = [0] * len(texts)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    assert [(got[i].class_id, got[i].n_links) for i in range(len(texts))] == list(zip(want, degree, strict=True))
    assert {i for i in got if got[i].kept} == {i for i in range(len(texts)) if want[i] == i}


def test_one_of_each_class_stays(spark):
    rows = [(5, "a b c d e f g h i j", "x"), (3, "a b c d e f g h i j", "y"), (3, "a b c d e f g h i j", "z"), (None, "a b c d e f g h i j", "w")]
    rows += [(1, None, "n"), (2, "", "e"), (2, "", "e"), (None, "alone here", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string")
    got = sorted((r.doc_id or 0, r.text or "", r.id) for r in ngram_join.keep_one(docs).collect())
    assert [g for g in got if g[0] == 3] in ([(3, rows[0][1], "y")], [(3, rows[0][1], "z")])
    assert [g for g in got if g[0] != 3] == [(0, "alone here", "q"), (1, "", "n"), (2, "", "e"), (2, "", "e")]
    assert ngram_join.keep_one(docs.limit(0)).count() == 0 and ngram_join.link(docs.limit(0)).count() == 0


def test_long_text(spark):
    draw = random.Random(0)
    long = [str(draw.randint(0, 9999)) for _ in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[:-300])), (3, " ".join(reversed(long)))], "doc_id long, text string")
    got = {r.id: (r.class_id, r.n_links) for r in ngram_join.link(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_query_against_all_pairs(spark, sf_dir, tables):
    rows = sorted((r.doc_id, r.text) for r in tables["documents"].collect())
    got = {r.doc_id: r for r in QUERIES["op5_ngram_join"](spark, sf_dir).collect()}
    pairs = _linked([t for _, t in rows])
    degree = [0] * len(rows)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    found = sum(got[d].n_links for d, _ in rows)
    assert all(got[d].n_links <= n for (d, _), n in zip(rows, degree, strict=True))
    assert found >= 0.99 * sum(degree)


def test_bands_reach_the_recall():
    for threshold, rows, recall in ((0.8, 7, 0.998), (0.5, 3, 0.9)):
        bands = ngram_join.bands_for(threshold, rows, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall > 1 - (1 - threshold**rows) ** (bands - 1)


def test_minhash_agreement_estimates_similarity():
    draw = np.random.default_rng(0)
    common = draw.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.sort(common[:3000]), np.sort(common[1000:])
    keys = ngram_join.band_hashes(np.concatenate([a, b]), np.array([0, 3000]), 2000, 1, 5)
    assert abs((keys[0] == keys[1]).mean() - 0.5) < 0.04


def test_jaccard_links():
    draw = random.Random(2)
    sets = [frozenset(draw.sample(range(40), draw.randint(1, 30))) for _ in range(40)]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    for threshold in (0.3, 0.5):
        got = ngram_join.jaccard_links(arrays, threshold)
        assert all(got[i, j] == (_jaccard(sets[i], sets[j]) >= threshold) for i in range(40) for j in range(40) if i != j)


# --- components and blocks ---------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.component for r in links.components(spark.createDataFrame(edges, "node long, other long")).collect()}
    want = plain.classes(400, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: want[n] for n in nodes}


def test_no_edges(spark):
    assert links.components(spark.createDataFrame([], "node long, other long")).count() == 0


def test_groups_cross_batches():
    rows = [("a", 1)] * 5 + [("a", 2)] + [("b", 2)] * 7
    table = pa.table({"k": [r[0] for r in rows], "m": [r[1] for r in rows], "n": list(range(13))})
    for size in (1, 2, 5, 100):
        got = [t.column("n").to_pylist() for t in links.by_group(iter(table.to_batches(size)), ["k", "m"])]
        assert got == [[0, 1, 2, 3, 4], [5], [6, 7, 8, 9, 10, 11, 12]]


# --- embeddings --------------------------------------------------------------------------------


def _cosines(rows, threshold):
    vectors = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            vectors[i] = np.array(v, np.float64) / np.linalg.norm(v)
    return [(i, j) for i in vectors for j in vectors if j < i and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= threshold]


@pytest.mark.parametrize("block", [4, 1024])
def test_links_equal_all_pairs(spark, block):
    draw = np.random.default_rng(3)
    rows = []
    for i in range(160):
        base = draw.normal(size=8) if i % 4 == 0 else base + draw.normal(size=8) * 0.25
        rows.append((i, [float(x) for x in np.float32(base)]))
    rows += [(200, None), (201, [0.0] * 8), (202, [float("nan")] + [1.0] * 7), (203, [None] + [1.0] * 7), (204, []), (205, rows[0][1])]
    rows += [(206, [x * 2 for x in rows[0][1]]), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [float("inf")] * 8), (210, [-0.0, 1.0]), (211, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.link(df, bits=3, recall=0.9999999, block=block).collect()}
    pairs = _cosines(rows, 0.9)
    want, degree = plain.classes(len(rows), pairs), [0] * len(rows)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    ids = [i for i, _ in rows]
    assert [(got[i].component_id, got[i].n_links) for i in ids] == [(ids[c], n) for c, n in zip(want, degree, strict=True)]
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)


def test_embedding_query(spark, sf_dir, tables):
    rows = sorted((r.vec_id, r.embedding) for r in tables["embeddings"].collect())
    got = {r.vec_id: r for r in QUERIES["op9_embedding_dedup"](spark, sf_dir).collect()}
    pairs, degree = _cosines(rows, 0.9), [0] * len(rows)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    assert sum(got[v].n_links for v, _ in rows) >= 0.99 * sum(degree)
    assert all(got[v].n_links <= n for (v, _), n in zip(rows, degree, strict=True))


def test_embedding_corner_cases(spark):
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (4, [1.0, 0.0], 2), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, Kept int")
    out = embedding_dedup.link(df)
    assert out.columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in out.collect())
    assert got == [(0, 0, 0, True), (0, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True)]
    assert embedding_dedup.link(df.limit(0)).count() == 0
