import numpy as np
import pytest
import xxhash

from spanloom.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            parent[max(find(i), find(int(j)))] = min(find(i), find(int(j)))
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_whole_table(spark, small):
    got = {r.doc_id: r for r in simhash.op8_simhash(spark, "/root/testdata/sf0.001").collect()}
    fps = np.array([brute_fp(t) for _, t in small], np.uint64)
    for (i, _), fp, root in zip(small, fps, brute_components([i for i, _ in small], fps), strict=True):
        assert got[i].fingerprint == f"{int(fp):016x}" and got[i].component_id == root


@pytest.mark.parametrize("hot_key", [4, 50_000])
def test_dense_groups(spark, hot_key):
    """Chains of codes one to three bits apart, in keys that are split once, twice or not at all."""
    r = np.random.default_rng(2)
    codes = [int(x) for x in r.integers(0, 2**63, 40, dtype=np.uint64)]
    for _ in range(400):
        c = codes[r.integers(0, len(codes))]
        for b in r.choice(64, r.integers(1, 4), replace=False):
            c ^= 1 << int(b)
        codes.append(c)
    codes = np.array(sorted(set(codes)), np.uint64)
    df = spark.createDataFrame([(int(c), i) for i, c in enumerate(codes.view(np.int64))], "fp long, rep long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, hot_key)).collect()}
    want = brute_components(list(range(len(codes))), codes)
    assert [roots.get(i, i) for i in range(len(codes))] == want


def test_index_finds_all_pairs():
    r = np.random.default_rng(3)
    codes = r.integers(0, 2**12, 300, dtype=np.uint64)
    group = r.integers(0, 3, 300)
    index = simhash.GrayIndex(group, codes)
    found = {tuple(sorted((int(index.order[a]), int(index.order[b])))) for i, j in index.pairs() for a, b in zip(i, j, strict=True)}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if group[a] == group[b] and int(codes[a] ^ codes[b]).bit_count() <= 3}
    assert found == want


def test_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs)
    assert got.count() == odd_docs.count()
    by = {r.doc_id: r.component_id for r in got.collect() if r.doc_id not in (None, 3)}
    assert by[0] == by[1] == by[7] == 0 and by[2] == by[4] == 2
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(0) == 1 and 1 not in ids and 7 not in ids and None in ids and 2 in ids and 4 not in ids
    assert simhash.near_duplicates(no_docs).collect() == [] and simhash.keep_one(no_docs).collect() == []


def test_ids_that_repeat_or_are_missing(spark):
    """Groups joined only through a row without an id; texts under one id; copies without any."""
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join([*words[:400 - k], *(f"v{i}" for i in range(k))]) for k in range(40)]
    fps = np.array([brute_fp(t) for t in chain], np.uint64)
    far = next((i, j, k) for i in range(40) for j in range(40) for k in range(40) if (fps[i] ^ fps[k]).item().bit_count() > 3 >= max((fps[i] ^ fps[j]).item().bit_count(), (fps[j] ^ fps[k]).item().bit_count()))
    a, bridge, c = (chain[i] for i in far)
    rows = [(1, a), (2, c), (None, bridge), (5, "quite another text"), (5, "and one more under five"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.component_id for r in simhash.near_duplicates(df).collect() if r.doc_id in (1, 2)} == {1}
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=repr)
    assert kept == sorted([(1, a), (5, "quite another text"), (5, "and one more under five"), (None, "no id")], key=repr)
