"""Every query against its SQL on the smallest tables."""

import pytest
from oracle import differences

from spanloom.plans.catalogue import QUERIES, SQL


#: Too slow in SQL over whole units, or greedy in order; tested against brute force in test_whole_jobs,
#: test_cascade, test_align, test_derivation, test_repair
#: and test_submit.
WITHOUT_SQL = {"subtree_starts", "cascade_differences", "feature_alignment", "span_claims", "repeated_spans", "annex_alignment", "derivation_census", "repair_fixpoint", "candidate_verdicts"}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL) | WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert differences(spark, "/root/testdata/sf0.001", QUERIES[name], SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
