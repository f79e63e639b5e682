import random

import plain
import pytest

from gaugeline.llm import mixture
from gaugeline.llm.queries import QUERIES


@pytest.mark.parametrize("seed", range(30))
def test_seats_equal_dealing_one_by_one(seed):
    draw = random.Random(seed)
    votes = [draw.choice([0.0, 1.0, 1.0, 5.0, draw.random() * 50]) for _ in range(draw.randint(1, 9))] + [1.0]
    seats = draw.randint(0, 60)
    assert mixture.sainte_lague(votes, seats) == plain.sainte_lague(votes, seats)


def test_no_source_above_its_seats():
    assert mixture.sainte_lague([10.0, 1.0], 11, [3, 5]) == [3, 5]


def test_targets_share_the_excess_by_weight():
    targets = mixture.fill_targets([10, 100, 1000], [3, 1, 2], 600, 2.0)
    assert targets[0] == 20 and targets[1] == pytest.approx(580 / 3) and targets[2] == pytest.approx(580 * 2 / 3)
    assert mixture.fill_targets([1, 1], [1, 1], 100, 2.0) == [2, 2]
    assert mixture.fill_targets([0], [1], 0.0, 2.0) == [0]


def _check(rows, block):
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        s = by.setdefault(r.source, [0, r.target, r.source_size, 0])
        s[0] += r.taken
        s[3] += r.size
    for taken, target, size, total in by.values():
        assert size == total and abs(taken - target) <= 2 * block
    return by


def test_query(spark, sf_dir, tables):
    texts = {r.doc_id: (len(plain.words(r.text)), r.source) for r in tables["documents"].collect()}
    got = QUERIES["op7_mixture"](spark, sf_dir).collect()
    again = QUERIES["op7_mixture"](spark, sf_dir).collect()
    assert sorted(got) == sorted(again) and len(got) == len(texts)
    assert all(r["size"] == texts[r.doc_id][0] for r in got)
    sizes = {}
    for n, source in texts.values():
        sizes[source] = sizes.get(source, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = plain.targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2.0)
    want = dict(zip(names, targets, strict=True))
    taken = {}
    for r in got:
        source = texts[r.doc_id][1]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source]) and 0 <= r.taken <= 2 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= mixture.BLOCK for s in names)


def test_shards_and_corner_cases(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["hot"] * 4 + ["a", None]), " ".join("w" * draw.randint(0, 30)), "x") for i in range(400)]
    rows += [(7, "hot", "w w", "x")] * 3 + [(None, None, None, None), (None, "b", "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, Taken string")
    kept = mixture.mix(docs, shard_words=500, block=4)
    assert [c for c in kept.columns if c != "text"] == ["doc_id", "source", "size", "source_size", "target", "taken"]
    first = kept.collect()
    _check(first, 4 * 12)
    assert sorted(map(str, first)) == sorted(map(str, mixture.mix(docs.repartition(5), shard_words=500, block=4).collect()))
    copies = mixture.repeat_rows(kept).collect()
    taken = sum(r.taken for r in first)
    assert sum(len(plain.words(r.text)) for r in copies) == taken and mixture.repeat_rows(kept).columns == ["doc_id", "source", "text"]
    assert mixture.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixture.mix(docs, max_sources=2)


@pytest.mark.parametrize("seed", range(30))
def test_targets_equal_filling_to_a_level(seed):
    draw = random.Random(seed)
    sizes = [draw.choice([0, 1, draw.randint(1, 20), draw.randint(1, 5000)]) for _ in range(draw.randint(1, 9))] + [3]
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    got = mixture.fill_targets(sizes, weights, 1.5 * sum(sizes), 2.0)
    assert got == pytest.approx(plain.targets(sizes, weights, 1.5 * sum(sizes), 2.0), abs=1e-6)


def test_texts_without_words_are_no_hot_key(spark):
    from pyspark.sql import functions as F

    empty = spark.range(100_000, numPartitions=8).select(
        F.col("id").alias("doc_id"), F.lit("small").alias("source"), F.when(F.col("id") % 2 == 0, F.lit(" ")).alias("text")
    )
    words = spark.createDataFrame([(-1, "small", "one"), (-2, "big", "w " * 400)], empty.schema)
    mixed = mixture.mix(empty.union(words)).cache()
    assert mixed.count() == 100_002 and mixed.where("size = 0 and taken <> 0").count() == 0
    assert {r.doc_id: r.taken for r in mixed.where("size > 0").collect()} == {-1: 2, -2: 600}
    plan = mixture.mix(empty.union(words))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1


def test_shards_stay_few(spark):
    rows = [(i, "hot", " ".join(["w"] * 20)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixture.mix(docs, shard_words=10, shards=5).collect()
    _check(got, mixture.BLOCK)
    assert sum(r.taken for r in got) == 6000
