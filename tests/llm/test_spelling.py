"""Spelling variants against brute force."""

import random
import re

import plain
import pytest

from gaugeline.llm import spelling
from gaugeline.llm.queries import QUERIES


def _got(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def _vocabulary(seed, n, letters="aeéÿ"):
    draw = random.Random(seed)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(5, 8))): draw.randint(1, 40) for _ in range(n)}
    long = "ab" * 40
    for i, w in enumerate([long, long[:-1], "x" + long[1:], long[:40] + "z" + long[41:], long[:40] + long[41:], "y" + long, long[1:] + "a", long[::-1]]):
        words[w] = i + 1
    return words


@pytest.mark.parametrize("seed, parts, block, rows", [(1, 8, 2048, 1 << 16), (2, 5, 7, 50), (3, 3, 3, 20), (4, 6, 2, 1000)])
def test_equals_brute_force(spark, monkeypatch, seed, parts, block, rows):
    monkeypatch.setattr(spelling, "_ROWS", rows)
    monkeypatch.setattr(spelling, "_PAIRS", 64)
    words = _vocabulary(seed, 250)
    frame = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert _got(spelling.variants(frame, parts=parts, block=block)) == plain.spellings(words)


def test_near_words_share_a_signature():
    draw = random.Random(7)
    for _ in range(200):
        a = "".join(draw.choice("aeionst") for _ in range(draw.randint(1, 12)))
        i, kind = draw.randrange(len(a)), draw.randrange(3)
        b = a[:i] + ("" if kind == 0 else draw.choice("aeionstz")) + a[i + (kind != 1) :]
        if a == b or not b:
            continue
        x, y = (spelling.signatures([w.encode("latin-1")], 6)[0] for w in (a, b))
        assert (x == y).argmax() == spelling._first_shared([a.encode("latin-1")], [b.encode("latin-1")], 6)[0] and (x == y).any()


def test_roots_of_long_chains(spark):
    words = {"a" * (5 + i): 2**i for i in range(20)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = _got(spelling.variants(frame))
    assert got == plain.spellings(words) and {r[1] for r in got.values()} == {"a" * 24}


def test_words_and_deletions(spark, monkeypatch):
    draw = random.Random(3)
    said = ["Straße", "straßen", "ÉCOLE", "école", "don't", "naïve×2", "a", "日本語word", "spelling", "speling"]
    rows = [(draw.choice([None, *range(40)]), " ".join(draw.choice(said) for _ in range(60))) for _ in range(80)] + [(1, None), (2, ""), (3, "x" * 100_000)]
    monkeypatch.setattr(spelling, "GROUP_BYTES", 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n")
    assert {r.word: r.n for r in spelling.count(docs, key="doc_id").collect()} == plain.spelling_words(rows)
    whole = {r.word: r.n for r in spelling.count(docs, least_length=1, least_count=1).collect()}
    assert sum(whole.values()) == sum(len(re.findall("[A-Za-zÀ-ÿ]+", t or "")) for _, t in rows)


def test_corner_cases(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).count() == 0
    for bad in ({"parts": 2}, {"ratio": 1}):
        with pytest.raises(ValueError):
            spelling.variants(empty, **bad)


def test_query_equals_brute_force(spark, sf_dir, tables):
    words = plain.spelling_words([(r.doc_id, r.text) for r in tables["documents"].collect()])
    assert _got(QUERIES["op13_spelling"](spark, sf_dir)) == plain.spellings(words)
