import pytest

from stratacat.registry import ORACLE, QUERIES

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_oracle(spark, name):
    same(spark, QUERIES[name], ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, SF).head(1)
