import pytest

from stratacat.llm.registry import ORACLE, QUERIES

from ..oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_oracle(spark, name):
    same(spark, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001")
