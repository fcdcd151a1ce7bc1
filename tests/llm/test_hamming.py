import numpy as np
import pytest

from spanloom.llm import hamming


def brute(ids, codes, queries, k):
    out = []
    for i in queries:
        d = np.bitwise_count(codes ^ codes[ids == i][0])
        near = [x for x in np.lexsort((ids, d)) if ids[x] != i][:k]
        out += [(int(i), r + 1, int(ids[x]), int(d[x])) for r, x in enumerate(near)]
    return sorted(out)


def frame(spark, ids, codes):
    return spark.createDataFrame([(int(i), int(c)) for i, c in zip(ids, codes.view(np.int64), strict=True)], "id long, code long").repartition(3)


@pytest.mark.parametrize("part", [10, 40, 200_000])
def test_copies_and_near_codes(spark, monkeypatch, part):
    monkeypatch.setattr(hamming, "PART", part)
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 3, dtype=np.uint64)
    codes = np.r_[np.repeat(base[:1], 150), base[r.integers(0, 3, 150)] ^ (np.uint64(1) << r.integers(0, 64, 150, dtype=np.uint64)), r.integers(0, 2**63, 60, dtype=np.uint64)]
    ids = np.arange(len(codes))
    df = frame(spark, ids, codes)
    assert sorted(map(tuple, hamming.top_k(df, df.filter("id % 20 = 0")).collect())) == brute(ids, codes, ids[ids % 20 == 0], 10)


def test_few_rows_and_none(spark):
    ids, codes = np.arange(4), np.array([0, 1, 3, 0], np.uint64)
    df = frame(spark, ids, codes)
    assert sorted(map(tuple, hamming.top_k(df.union(df), df).collect())) == brute(ids, codes, ids, 10)
    assert hamming.top_k(df.limit(0), df.limit(0)).collect() == []


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    codes = hamming.sign_codes(rows).toPandas()
    got = sorted(map(tuple, hamming.op2_top_k_search(spark, "/root/testdata/sf0.001").collect()))
    ids = codes.id.to_numpy()
    assert got == brute(ids, codes.code.to_numpy().view(np.uint64), ids[ids % 20 == 0], 10)


def test_vectors_without_values(spark):
    df = spark.createDataFrame([(1, [1.0] * 64), (2, None), (None, [1.0] * 64), (3, [-1.0] * 64), (4, []), (5, [1.0] * 8)], "vec_id long, embedding array<float>")
    assert {r.id: r.code for r in hamming.sign_codes(df).collect() if r.id != 5} == {1: -1, 3: 0}


def test_segments_and_masks():
    for n in (0, 1, 5, 300, 51_000, 10**6, 10**9, 10**14):
        cuts = hamming.segments(n)
        assert sum(w for _, w in cuts) == 64 and all(w <= 22 for _, w in cuts)
        assert [low for low, _ in cuts] == [sum(w for _, w in cuts[:j]) for j in range(len(cuts))]
    assert sorted(hamming.masks(5, 2).tolist()) == [x for x in range(32) if x.bit_count() == 2]
    assert hamming.masks(3, 0).tolist() == [0] and not len(hamming.masks(3, 4))


def test_far_codes(spark):
    """Neighbours at any distance, up to opposite codes, are found by the last radius."""
    ids, codes = np.arange(3), np.array([0, 2**64 - 1, 2**63 + 5], np.uint64)
    df = frame(spark, ids, codes)
    assert sorted(map(tuple, hamming.top_k(df, df, 2).collect())) == brute(ids, codes, ids, 2)
