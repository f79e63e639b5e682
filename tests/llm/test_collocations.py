"""Phrase collocations against brute force."""

import random

import numpy as np
import plain
import pytest

from gaugeline.llm import collocations
from gaugeline.llm.queries import QUERIES


def _rows(seed, n=60):
    draw = random.Random(seed)
    vocabulary = ["a", "B", "b", "cé", "É", "日本", "x1", "the", "The"]
    fixed = ["one two three four five six", "The a b", "x1 x1 x1 x1"]
    rows = []
    for _ in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else draw.choice(vocabulary) for _ in range(draw.randint(0, 25))]
        text = "".join(p + draw.choice([" "] * 8 + ["\t", "  ", ", ", ".", "\n", "!?", "\x0c", "\r\n"]) for p in parts)
        rows.append((draw.choice(["en", "en", "de", None, "und", "", "Zz"]), text))
    return [*rows, (None, None), ("en", ""), ("en", " ;; "), rows[0], rows[0], ("en", "pi po " * 2000)]


def _got(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize(
    "seed, least, longest, tile, fan_in, absorbed, held",
    [(1, 3, 5, 2, 64, 100, 0), (2, 2, 4, 3, 2, 100, 10**6), (3, 1, 5, 2048, 64, 100, 10**6), (4, 4, 6, 1, 3, 70, 0)],
)
def test_equals_brute_force(spark, monkeypatch, seed, least, longest, tile, fan_in, absorbed, held):
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 300)
    monkeypatch.setattr(collocations, "FAN_IN", fan_in)
    rows = _rows(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = _got(collocations.top_phrases(docs, 50, min_count=least, longest=longest, tile=tile, absorbed=absorbed))
    assert got == sorted(plain.collocations(rows, longest, least, 50, absorbed))


def test_products_beyond_64_bits(spark):
    frame = spark.createDataFrame(
        [(3_000_000_001, 9_000_000_000_000_007, [4_000_000_000, 3_500_000_000], [5_000_000_019, 3_000_000_001])],
        "n long, total long, heads array<long>, tails array<long>",
    )
    score, k = frame.select(collocations._lowest_cut().alias("c")).first().c
    wanted = [1000 * 3_000_000_001 * 9_000_000_000_000_007 // (x * y) for x, y in ((4_000_000_000, 5_000_000_019), (3_500_000_000, 3_000_000_001))]
    assert (score, k) == min((s, i + 1) for i, s in enumerate(wanted))


def test_dense_and_sparse_tiles_agree():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 40, 5000), draw.integers(0, 300, 5000)
    for side in (1, 7, 64, 1000):
        found = {}
        for x, y, codes, counts in collocations.tile_counts(a, b, side):
            assert (np.diff(codes) > 0).all()
            found |= {(x * side + int(c) // side, y * side + int(c) % side): int(n) for c, n in zip(codes, counts)}
        want = {}
        for p in zip(a.tolist(), b.tolist()):
            want[p] = want.get(p, 0) + 1
        assert found == want


def test_corner_cases(spark):
    docs = spark.createDataFrame([("en", "to be or not to be " * 60, 1)], "lang string, text string, CHUNK int")
    rows = [("en", "to be or not to be " * 60)]
    assert _got(collocations.top_phrases(docs)) == sorted(plain.collocations(rows))
    assert collocations.top_phrases(docs.limit(0)).count() == 0
    assert collocations.top_phrases(docs.select("lang", "text"), min_count=10_000).count() == 0
    with pytest.raises(ValueError):
        collocations.phrases(docs, longest=1)


def test_query_equals_brute_force(spark, sf_dir, tables):
    rows = [(r.lang, r.text) for r in tables["documents"].collect()]
    got = _got(QUERIES["op12_collocations"](spark, sf_dir))
    assert got == sorted(plain.collocations(rows)) and got
