"""Documents taken in part keep their text as it is."""

import random

import plain

from gaugeline.llm import mixture


def test_partial_texts_are_prefixes(spark):
    draw, rows = random.Random(8), []
    for i in range(60):
        gaps = ["", *[draw.choice([" ", "\n", "  ", "\n\n\t"]) for _ in range(draw.randint(0, 40))]]
        text = draw.choice(["", " ", "\n"]) + "".join(g + draw.choice(["a", "é中", "😀."]) for g in gaps) + draw.choice(["", "\n"])
        rows.append((i, draw.choice("ab"), text))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixture.mix(docs, weights=(7.0, 5.0), share=0.7, block=1, shard_words=100)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    whole = {i: text for i, _, text in rows}
    words, parts = dict.fromkeys(taken, 0), 0
    for r in mixture.repeat_rows(mixed).collect():
        assert whole[r.doc_id].startswith(r.text)
        parts += r.text != whole[r.doc_id] and "\n" in r.text.strip()
        words[r.doc_id] += len(plain.words(r.text))
    assert words == taken and parts > 0
