import pytest

from oracle import assert_same, connect
from strata.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(SF), ORACLES[name])
