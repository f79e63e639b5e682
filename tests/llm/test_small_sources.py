"""Sources smaller than a block of the mix."""

import pytest

from gaugeline.llm import mixture


def test_small_sources_get_their_target(spark):
    sizes = {"a": 3, "b": 15, "c": 1, "d": 40, "z": 5000, None: 7}
    rows = [(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate(sizes.items())] + [(9, "e", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.source: r for r in mixture.mix(docs).collect()}
    assert got["a"].target == 6
    for source, n in sizes.items():
        near = 1 if got[source].target < mixture.BLOCK else mixture.BLOCK
        assert got[source].taken == pytest.approx(got[source].target, abs=near) and 0 < got[source].taken <= 2 * n
    assert got["e"].taken == 0
    copies = {r.source for r in mixture.repeat_rows(mixture.mix(docs)).collect()}
    assert copies == set(sizes)
