import pytest
from oracle import connect, differences

from gaugeline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = connect(sf_dir)
    report = differences(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert not report, report
