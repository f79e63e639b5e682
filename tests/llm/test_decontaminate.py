"""Benchmark decontamination against brute force."""

import random

import plain
import pytest

from gaugeline.llm import chunks, decontaminate
from gaugeline.llm.queries import QUERIES


def _data(seed):
    draw = random.Random(seed)
    vocabulary = ["A", "b", "cé", "日本", "x1", "Z", "z", "ÉA", "\U0001f600", "9"]

    def text(n):
        return "".join(draw.choice(vocabulary) + draw.choice([" ", ", ", "\n", "--", "\x00", " `{"]) for _ in range(n))

    items = [(draw.randint(0, 12), text(draw.randint(0, 7))) for _ in range(14)] + [(None, text(3)), (3, None), (4, ""), (77, "...")]
    docs = [text(draw.randint(0, 40)) for _ in range(40)] + [None, "", "?!", "".join(t or "" for _, t in items), items[0][1], items[0][1]]
    return docs, items


def _check(spark, docs, items, **options):
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find(table, asked, **options).collect()}
    assert len(got) == len(docs)
    for i, text in enumerate(docs):
        n, hit, runs, ids = plain.occurrences(text, items, options.get("window", 10))
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.text) == (n, len(hit), ids, text)
        assert [tuple(h) for h in r.hits] == runs
    return got


@pytest.mark.parametrize("seed, window, part_windows", [(1, 3, 100_000), (2, 1, 100_000), (3, 4, 100_000), (4, 3, 5), (5, 2, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, window, part_windows):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 300)
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 200)
    _check(spark, *_data(seed), window=window, part_windows=part_windows)


def test_one_phrase_in_many_items(spark):
    items = [(i, "which of the following is the best answer to the question " + str(i)) for i in range(2000)]
    docs = ["Which of the following is the best answer to the question?", "which of the following is the best answer", items[7][1]]
    got = _check(spark, docs, items[:30])
    assert len(got[0]["items"]) == 30
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    many = decontaminate.find(table, spark.createDataFrame(items, "item_id long, text string"), part_windows=700)
    assert [len(r["items"]) for r in many.orderBy("doc_id").collect()] == [2000, 0, 2000]


def test_corner_cases(spark):
    rows = [(None, "one two three", 1, "a"), (1, "one two three", 2, None), (1, "one two three", 2, None), (2, "w " * 300_000 + "one two three", 3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_HIT int, chunk string")
    items = spark.createDataFrame([(5, "Two, three")], "item_id long, text string")
    for part_windows in (100_000, 1):
        more = items.union(spark.createDataFrame([(6, "two three")], items.schema)) if part_windows == 1 else items
        out = decontaminate.find(docs, more, part_windows=part_windows)
        assert sorted(out.columns) == sorted(["doc_id", "text", "chunk", "n_words", "n_hit", "hits", "items"])
        got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"], tuple(r.hits[0])) for r in out.collect())
        named = ["5", "6"] if part_windows == 1 else ["5"]
        assert got == [(0, 3, 2, named, (4, 13)), (1, 3, 2, named, (4, 13)), (1, 3, 2, named, (4, 13)), (2, 300_003, 2, named, (600_004, 600_013))]
    assert decontaminate.find(docs.limit(0), items).count() == 0
    assert decontaminate.find(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.keep_clean(docs, items).columns == docs.columns
    with pytest.raises(ValueError):
        decontaminate.find(docs, items, window=0)


def test_query_equals_brute_force(spark, sf_dir, tables):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op11_decontaminate"](spark, sf_dir).collect()}
    for r in tables["documents"].collect():
        n, hit, _, ids = plain.occurrences(r.text, items, 10)
        assert (got[r.doc_id].n_words, got[r.doc_id].n_hit, got[r.doc_id].n_items) == (n, len(hit), len(ids))
        assert got[r.doc_id].items_sha256 == plain.sha(",".join(ids)) and got[r.doc_id].contaminated == bool(hit)
