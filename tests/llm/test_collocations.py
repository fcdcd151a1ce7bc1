import random
from collections import Counter

import numpy as np
from conftest import rows_of  # noqa: F401
from pyspark.sql import functions as F

from spanloom.llm import collocations as co


def brute(rows, least, absorbed, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = piece.replace("\t", " ").split(" ")
            words = [w for w in words if w]
            n[lang] += len(words)
            for m in range(1, 5):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        if any(lg == lang and len(q) > len(p) and 100 * b >= absorbed * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (lg, q), b in cand.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top]))


def found(df, **options):
    return sorted(tuple(r) for r in co.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_counting(spark):
    rng = random.Random(1)
    texts = [(rng.choice(["en", "de", None]), "".join(rng.choice(["a", "b", "C", "d é"]) + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  "]) for _ in range(rng.randint(0, 90)))) for _ in range(60)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    want = brute(texts, 5, 80, 25)
    assert len(want) > 30 and found(df, least=5, top=25) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert found(odd_docs, least=2) == brute(rows, 2, 80, 2000)
    assert found(no_docs) == []


def test_summaries_keep_all_that_is_frequent():
    """Merged in any order with little room, nothing that reaches the threshold is lost."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        keys = rng.zipf(1.3, 4000).astype(np.uint64) % np.uint64(3000)
        least = int(rng.integers(5, 60))
        s = co.Summary(len(keys) // least + 1)
        for part in np.array_split(keys, 7):
            s.waiting.append(np.unique(part, return_counts=True))
            s.merge()
        true = Counter(keys.tolist())
        kept = set(s.survivors(least).tolist())
        assert len(s.keys) <= s.room and s.lost < least
        assert {k for k, c in true.items() if c >= least} <= kept


def test_survivors_by_partition(spark):
    """The job keeps all frequent names, whatever the number of counters aimed at."""
    rows = spark.range(20_000).select((F.col("id") * F.col("id") % 701).alias("name"), F.lit(1).cast("long").alias("c")).repartition(6)
    frequent = {r.name for r in rows.groupBy("name").count().filter("count >= 40").collect()}
    for counters in (10, 500_000):
        assert frequent <= {r.name for r in co.frequent_names(rows, 40, counters).collect()}


def test_a_full_map_loses_nothing(spark, monkeypatch):
    """With a map of few bits nearly all phrases pass it; the counts stay exact."""
    texts = [("en", f"x y z {i} {i % 7} x y") for i in range(300)]
    df = spark.createDataFrame(texts, "lang string, text string")
    monkeypatch.setattr(co, "MAP_BITS", 1 << 16)
    assert found(df, least=20) == brute(texts, 20, 80, 2000)


def test_names_are_shuffled_packed(spark):
    """A row holds the names of many phrases, so their number is that of partitions, not of names."""
    counted = spark.range(20_000, numPartitions=2).select((F.col("id") % 7).cast("int").alias("part"), F.xxhash64("id").alias("name"), F.lit(3).cast("long").alias("c"))
    rows = co.packed(counted).collect()
    assert len(rows) <= 7 * 2 * (1 + 10_000 // 7 // co.PACK) and sum(len(r.names) for r in rows) == sum(len(r.counts) for r in rows) == 160_000
