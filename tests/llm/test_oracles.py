import pytest
from oracle import differences

from spanloom.llm.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLE_SQL[name]) == ""


def test_one_query_for_each_number():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
