"""Numbers of words go back to the chunks without a row per chunk and word."""

import plain
from pyspark.sql.classic.dataframe import DataFrame

from gaugeline.llm import collocations


def test_join_of_words_has_a_row_per_word(spark, monkeypatch):
    joined, join = [], DataFrame.join

    def watched(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, list) and on == ["lang", "word"]:
            joined.append(out)
        return out

    monkeypatch.setattr(DataFrame, "join", watched)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 300)
    rows = [("en" if i % 3 else None, "one two three four five six " * 6 + f"rare{i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = collocations.top_phrases(docs, 50, min_count=40)
    found = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got.collect())
    assert found == sorted(plain.collocations(rows, 5, 40, 50, 100))
    # six words of two languages in some hundred chunks
    assert [out.count() for out in joined] == [12]
    assert sum(len(x) for x, in joined[0].select("chunks").collect()) > 400
