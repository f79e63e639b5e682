"""Substring and line de-duplication against brute force."""

import random

import plain
import pytest

from gaugeline.llm import chunks, line_dedup, substring_dedup
from gaugeline.llm.queries import QUERIES


def _texts(seed, n=60):
    draw = random.Random(seed)
    passages = [" ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(4, 14))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [
            draw.choice(passages) if draw.random() < 0.5 else " ".join(str(draw.randint(0, 400)) for _ in range(draw.randint(0, 9)))
            for _ in range(draw.randint(0, 6))
        ]
        out.append(draw.choice(["\n", " ", "\n\n", "\t"]).join(parts))
    return [*out, None, "", "\n\n", out[0], out[0], " ".join(["same"] * 40), "lone"]


@pytest.mark.parametrize("window, chunk_bytes", [(1, 200), (5, 200), (8, 1 << 20)])
def test_substrings(spark, monkeypatch, window, chunk_bytes):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    texts = _texts(window)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, window=window).collect()}
    digests = {r.doc_id: r for r in substring_dedup.repeat_digests(docs, window=window).collect()}
    for i, (n, removed, kept) in enumerate(plain.substring_removed(texts, window)):
        assert (got[i].n_words, got[i].n_removed) == (n, removed)
        assert got[i].text == (" ".join(kept) if removed else texts[i])
        assert digests[i].kept_sha256 == plain.sha(" ".join(kept))


@pytest.mark.parametrize("min_words, chunk_bytes", [(1, 200), (3, 1 << 20), (9, 200)])
def test_lines(spark, monkeypatch, min_words, chunk_bytes):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    texts = _texts(10 + min_words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.delete_repeats(docs, min_words=min_words).collect()}
    for i, want in enumerate(plain.lines_deleted(texts, min_words)):
        assert (got[i].n_lines, got[i].n_deleted, got[i].text) == want


def test_queries_equal_brute_force(spark, sf_dir, tables):
    rows = sorted((r.doc_id, r.text) for r in tables["documents"].collect())
    got = {r.doc_id: r for r in QUERIES["op6_substring_dedup"](spark, sf_dir).collect()}
    for (doc, _), (n, removed, kept) in zip(rows, plain.substring_removed([t for _, t in rows], 35), strict=True):
        assert (got[doc].n_words, got[doc].n_removed, got[doc].kept_sha256) == (n, removed, plain.sha(" ".join(kept)))
    got = {r.doc_id: r for r in QUERIES["op10_line_dedup"](spark, sf_dir).collect()}
    for (doc, _), (n, deleted, left) in zip(rows, plain.lines_deleted([t for _, t in rows], line_dedup.MIN_WORDS), strict=True):
        assert (got[doc].n_lines, got[doc].n_deleted, got[doc].left_sha256) == (n, deleted, plain.sha(left or ""))


def test_corner_cases(spark):
    words = " ".join(str(i) for i in range(40_000))
    rows = [(None, "x y z", 1, "a"), (1, "x y z", 2, None), (1, "x y z", 2, None), (2, words, None, "b"), (3, None, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_WORDS int, chunk string")
    out = substring_dedup.remove_repeats(docs, window=3)
    assert sorted(out.columns) == sorted(["doc_id", "text", "chunk", "n_words", "n_removed"])
    got = sorted((r.doc_id or -1, r.text, r.n_words, r.n_removed, r.chunk) for r in out.collect() if r.text is not None)
    assert got == [(-1, "", 3, 3, "a"), (1, "", 3, 3, None), (1, "", 3, 3, None), (2, words, 40_000, 0, "b")]
    out = line_dedup.delete_repeats(docs, min_words=3)
    got = sorted((r.doc_id or 9, r.text or "", r.n_lines, r.n_deleted) for r in out.collect())
    assert got == [(1, "", 1, 1), (1, "x y z", 1, 0), (2, words, 1, 0), (3, "", 1, 0), (9, "", 1, 1)]
    assert substring_dedup.repeat_digests(docs.limit(0)).count() == 0
    assert line_dedup.delete_repeats(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.delete_repeats(docs, min_words=0)


def test_many_blank_lines_before_a_passage(spark):
    text = "\n" * 3000 + "one two three four"
    docs = spark.createDataFrame([(1, text), (2, "a b c d\n" + text)], "doc_id long, text string")
    got = {r.doc_id: r.n_deleted for r in line_dedup.delete_repeats(docs, min_words=4).collect()}
    assert got == {1: 0, 2: plain.lines_deleted([text, "a b c d\n" + text], 4)[1][1]}
