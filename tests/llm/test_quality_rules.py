import random

import plain
from pyspark.sql import functions as F

from gaugeline.llm import quality_rules as Q
from gaugeline.llm.queries import QUERIES

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures_match_brute_force(spark):
    draw = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b c d e f g h " * 2, "x " * 9, "x " * 8, "é#ü$ 中|\n中|\n\n 中| \n"]
    for _ in range(300):
        texts.append(draw.choice([" ", "\n", "\x0b"]).join(draw.choice("abc#&é") * draw.randint(1, 2) for _ in range(draw.randint(0, 60))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.measure(docs).collect():
        assert tuple(r[m] for m in BASE) == plain.quality(texts[r.doc_id]), texts[r.doc_id]


def test_query(spark, sf_dir, tables):
    texts = {r.doc_id: r.text for r in tables["documents"].collect()}
    df = QUERIES["op1_quality_rules"](spark, sf_dir)
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    got = df.collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain.quality(texts[r.doc_id])
        assert tuple(r[m] for m in BASE) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.rule is None)


def test_rules_are_learned_from_labels(spark):
    draw = random.Random(1)
    rows = []
    for i in range(1200):
        kind = draw.choice(["good", "good", "good", "symbols", "shouting"])
        words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(30, 200))]
        if kind == "symbols":
            words = [w + draw.choice(["###", "&&&", ""]) for w in words]
        if kind == "shouting":
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), kind))
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    labels = docs.where("doc_id % 3 < 2").select("doc_id", (F.col("words") == "good").cast("int").alias("quality"))
    labels = labels.union(spark.createDataFrame([(1, None), (99_999, 0)], labels.schema))
    out = Q.learn_and_judge(docs, labels).where("doc_id % 3 = 2").groupBy("words").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    kept = {r.words: r.kept for r in out.collect()}
    assert kept["good"] > 0.99 and kept["symbols"] < 0.05 and kept["shouting"] < 0.05


def test_order_and_text_of_a_list(spark):
    few = Q.Rule((Q.Condition("words", False, 3.0),))
    loud = Q.Rule((Q.Condition("marks_per_word", True, 1.0), Q.Condition("words", True, 2.0)))
    rules = Q.DecisionList((loud, few))
    docs = spark.createDataFrame([(1, "a! b! c!"), (2, "a! b!"), (3, "a"), (4, "a b c"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.rule, r.kept) for r in Q.judge(Q.measure(docs), rules).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (1, False), 4: (None, False), 5: (1, False)}
    assert str(loud) == "marks_per_word >= 1 and words >= 2"


def test_corner_cases(spark):
    long = "all different " + " ".join(map(str, range(30_000)))
    rows = [(None, None, 1), (1, "", 2), (2, long, 3), (2, long, 3), (3, "r " * 20_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_words int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = Q.learn_and_judge(docs, none)
    assert out.columns == ["doc_id", "text", *Q.MEASURES, "base_failed", "rule", "kept"]
    got = sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in out.collect())
    assert got == [(0, 0, 0, True, False), (1, 0, 0, True, False), (2, 30_002, 0, False, True), (2, 30_002, 0, False, True), (3, 20_000, 20_000, True, False)]
    one_kind = spark.createDataFrame([(2, 1), (2, 1)], "doc_id long, quality int")
    assert Q.learn_and_judge(docs, one_kind).where("kept").count() == 2
    assert Q.learn_and_judge(docs.limit(0), none).count() == 0
