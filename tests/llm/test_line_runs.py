"""Line de-duplication of whole repeated runs against brute force."""

import random

import plain
import pytest

from gaugeline.llm import chunks, line_dedup


def _got(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [(r.n_lines, r.n_deleted, r.text) for r in line_dedup.delete_repeats(docs, **options).orderBy("doc_id").collect()]


def test_copy_is_left_empty(spark):
    text = " ".join(f"w{i}" for i in range(100)) + "\na b c d e"
    assert _got(spark, [text, text]) == plain.lines_deleted([text, text], line_dedup.MIN_WORDS) == [(2, 0, text), (2, 2, "")]


@pytest.mark.parametrize("min_words, chunk_bytes", [(1, 200), (3, 1 << 20), (9, 200), (9, 1 << 20)])
def test_runs_go_to_their_end(spark, monkeypatch, min_words, chunk_bytes):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk_bytes)
    draw = random.Random(min_words)
    lines = ["", " ", "x", *[" ".join(draw.choice("abcde") for _ in range(draw.randint(1, 6))) for _ in range(8)]]
    texts = ["\n".join(draw.choice(lines) for _ in range(draw.randint(0, 12))) for _ in range(40)]
    texts += [None, "", texts[0], texts[1], "\n".join([lines[5]] * 9)]
    assert _got(spark, texts, min_words=min_words) == plain.lines_deleted(texts, min_words)
