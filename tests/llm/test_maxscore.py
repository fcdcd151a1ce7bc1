import math
import random
from collections import Counter

import numpy as np

from spanloom.llm import maxscore as ms


def terms(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def brute(docs, items, k=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t, Counter(t)) for i, t in held if t]
    n, length = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(x for _, _, c in held for x in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, t, c in held:
            m = 100 - 25 + (25 * len(t) * n) // length
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 12 * m)) for x, q in Counter(terms(text)).items() if c[x])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted((tuple(r) for r in ms.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_terms():
    for text in ("It's A_b-C 9é ÀB\x7f~x", "", "  ", "É1", "a\xa0b\n\tc"):
        assert [t.decode() for t in ms.terms(text.encode())] == terms(text)


def test_against_brute_force(spark, monkeypatch):
    """Many small blocks and chunks, so that bounds skip chunks and drop documents."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 40)))) for i in range(700)]
    docs += [(i + 700, docs[i][1]) for i in range(40)] + [docs[5], (None, docs[6][1]), (None, docs[6][1]), (9001, None)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(25)] + [(25, None), (26, "nowhere"), (3, "w1 w2")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 5)
    assert found(d, q, k=5) == want
    assert found(d, q, k=5, most_terms=40) == want  # several groups of queries


def test_blocks_by_hand():
    """Every block size gives the scores of a plain sum, for every threshold."""
    rng = np.random.default_rng(4)
    queries = ms.Queries([0], [[(t, int(rng.integers(1, 3))) for t in range(8)]], {})
    for _ in range(20):
        rows = int(rng.integers(1, 900))
        held = [np.flatnonzero(rng.random(8) < 0.3) for _ in range(rows)]
        count = np.array([len(x) for x in held])
        term = np.concatenate(held).astype(np.int64) if count.sum() else np.zeros(0, np.int64)
        times = rng.integers(1, 5, len(term))
        weight = rng.integers(0, 3000, 8)
        import pyarrow as pa

        batch = ms.block_row(pa.array(np.arange(rows)), np.maximum(count, 1), count, term, times, weight, queries.pairs(), 1000, 5000)
        block = ms.Block({name: batch.column(name)[0].values for name in batch.schema.names})
        total = np.zeros(ms.BLOCK, np.int64)
        m = 75 + 25 * np.maximum(count, 1) * 1000 // 5000
        doc = np.repeat(np.arange(rows), count)
        q = np.array([x for _, x in queries.terms[0]])
        np.add.at(total, doc, q[term] * weight[term] * ((10**9 * times) // (1000 * times + 12 * m[doc])))
        for least in (0, 1, int(np.median(total[:rows])), int(total.max()), int(total.max()) + 1):
            docs, score = block.search(queries.terms[0], least)
            assert sorted(docs.tolist()) == np.flatnonzero(total >= max(least, 1)).tolist()
            assert (score == total[docs]).all()


def test_bounds_of_pairs_hold():
    """What a pair saves never takes its bound below the greatest joint score."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    query = [(0, 3), (1, 1)]
    rows = 600
    held = [np.flatnonzero(rng.random(2) < 0.5) for _ in range(rows)]
    count = np.array([len(x) for x in held])
    term, times = np.concatenate(held), rng.integers(1, 9, count.sum())
    batch = ms.block_row(pa.array(np.arange(rows)), np.ones(rows, np.int64), count, term, times, np.array([900, 400]), {0: [1]}, 10, 10)
    block = ms.Block({name: batch.column(name)[0].values for name in batch.schema.names})
    tops = [q * block.most(t) for t, q in query]
    bound = tops[0] + tops[1] - block.saving(*query, *tops)
    docs, score = block.search(query, 1)
    most = np.zeros(ms.CHUNKS, np.int64)
    np.maximum.at(most, docs // ms.CHUNK, score)
    assert (bound >= most).all() and (bound <= tops[0] + tops[1]).all() and bound.sum() < (tops[0] + tops[1]).sum()


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two id"), (2, ""), (3, None), (1, "one two id")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert found(odd_docs, items) == brute(rows, [tuple(r) for r in items.collect()])
    assert found(no_docs, items) == [] and found(odd_docs, items.limit(0)) == []
