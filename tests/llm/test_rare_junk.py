"""A kind of junk that is a small share of all junk."""

import random

from gaugeline.llm import quality_rules as Q


def test_rare_junk_at_the_end_of_a_feature_gets_a_rule(spark):
    draw, rows = random.Random(4), []
    for kind, n in (("good", 3000), ("symbols", 1000), ("marks", 15)):
        for _ in range(n):
            words, lines = draw.randint(200, 2000), draw.randint(5, 20)
            symbols = words * draw.uniform(1, 2) if kind == "symbols" else words * draw.uniform(0, 0.1)
            marks = words * (draw.uniform(0.5, 0.9) if kind == "marks" else draw.uniform(0, 0.3))
            rows.append((kind, words, int(words * draw.uniform(4, 6)), int(symbols), 0, 0, lines, 10, int(marks)))
    measured = spark.createDataFrame(rows, "kind string, " + ", ".join(f"{m} long" for m in Q.MEASURES))
    rules = Q.fit(measured, measured["kind"] != "good")
    kept = {r.kind: r["count"] for r in Q.judge(measured, rules).where("kept").groupBy("kind").count().collect()}
    assert kept.get("marks", 0) == 0 and kept.get("symbols", 0) <= 10 and kept["good"] >= 2970
