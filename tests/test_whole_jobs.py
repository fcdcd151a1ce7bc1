"""Queries that once did a part of the job, against plain Python over whole tables or small ones of their own."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as fn
from spanloom.operators import edges
from spanloom.plans.queries import QUERIES
from spanloom.sources import text as src

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        return str(tmp_path)

    return put


def test_subtree_starts_walks_to_the_root(spark):
    """A chain of forty, a branch, a ring with a tail, and a token that is its own head."""
    heads = [*range(2, 41), 0, 20, 43, 44, 42, 42, 46]
    want = {}
    for u in range(1, len(heads) + 1):
        path = [u]
        while (h := heads[path[-1] - 1]) and h not in path:
            path.append(h)
        for top in path:
            want.setdefault(top, []).append(u)
    rows = [(1, 1, u, h, "x") for u, h in enumerate(heads, 1)]
    made = edges.subtree_starts(spark.createDataFrame(rows, "doc_id long, unit long, u int, head int, deprel string")).collect()
    assert {r.u: (r["first"], r["size"]) for r in made} == {u: (min(v), len(v)) for u, v in want.items()}


def test_all_lines_vote(spark):
    votes = {}
    for r in src.lines(spark.read.parquet(f"{SMALL}/documents.parquet")).select("doc_id", "text").collect():
        votes.setdefault(r.doc_id, Counter())[f"a{len(r.text) % 3}"] += 1
    got = {r.doc_id: r for r in QUERIES["majority_vote"](spark, SMALL).collect()}
    assert {k: (r.votes, r.n) for k, r in got.items()} == {k: (max(c.values()), sum(c.values())) for k, c in votes.items()}
    assert max(r.n for r in got.values()) > 3


def test_roman_numbers_of_long_documents(spark, tables):
    got = {r.line: r for r in QUERIES["roman_numbers"](spark, tables([(1, "\n".join(["x"] * 450))])).collect()}
    assert len(got) == 450 and all(r.parsed == line for line, r in got.items())
    assert (got[100].roman, got[449].roman) == ("C", "CDXLIX")
    back = spark.range(1, 4200).select("id", fn.from_roman(fn.to_roman(F.col("id"))).alias("back"))
    assert back.filter("back is null or back <> id").count() == 0


def test_all_documents_are_checked(spark, tables):
    got = QUERIES["changed_artifacts"](spark, tables([(1, "a"), (2, "b"), (3, "c"), (5, "c"), (4, "d"), (7, "d")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, hashlib.sha256(b"a").hexdigest()), (2, hashlib.sha256(b"b").hexdigest())]
