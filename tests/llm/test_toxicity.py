import random

import pytest

from spanloom.llm import toxicity as tx

LEX = tx.Lexicon({"idiot": 3.0, "scum ": 2.0, "vequ": 1.0, "los": 0.5, "los ": 1.5}, frozenset({"idiot proof", "the scum"}), (-4.0, 0.0, 1.0, 1.0))


@pytest.mark.parametrize(
    ("text", "hits", "weight"),
    [
        ("you idiot", 1, 3.0), ("you 1d10t", 1, 3.0), ("iDi0ts!", 1, 3.0), ("іdіоt", 1, 3.0), ("ｉｄｉｏｔ", 1, 3.0), ("id​iot", 1, 3.0), ("ïdîot", 1, 3.0),
        ("$cum", 1, 2.0), ("scum###", 1, 2.0), ("scummy", 0, 0), ("oscum", 0, 0), ("the scum", 0, 0), ("the $cum", 0, 0), ("a scum", 1, 2.0),
        ("idiot proof", 0, 0), ("idiot, proof", 0, 0), ("vequaire vequé", 2, 2.0), ("los", 1, 1.5), ("lost", 1, 0.5), ("1o5t", 1, 0.5), ("", 0, 0), (None, 0, 0), ("plain 123 words", 0, 0),
    ],
)
def test_matching(text, hits, weight):
    found = LEX.measure(*tx.folded(text))
    assert found == (hits, weight)


def test_length_counts():
    text = "idiot " + "w " * 20
    long = "idiot " + "w " * 20_000
    short, far = (LEX.score(*LEX.measure(*tx.folded(t)), len(t.split())) for t in (text, long))
    assert short > far > LEX.score(0, 0.0, 50)


def corpus(spark, n=1500):
    """Toxic documents hold one of two words, or a stem in another language; some are copies."""
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        text = rng.choices(words, k=rng.randint(20, 200))
        if toxic:
            bad = ["grob" + rng.choice(words)] if i % 16 else ["schuft", "lump"]
            for _ in range(1 + len(text) // 30):
                text[rng.randrange(len(text))] = rng.choice(bad)
        elif i % 40 == 1:
            text[:2] = ["edler", "lump"]
        docs.append((i, " ".join(text), "x"))
        labels.append((i, 1, int(toxic)))
    copy = "seltsam " + docs[8][1]
    docs += [(n + i, copy + f" w{i}", "x") for i in range(60)]
    labels += [(n + i, 1, 1) for i in range(60)]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learning(spark):
    docs, labels = corpus(spark)
    lexicon = tx.fit(docs, labels)
    assert any(e.startswith("schuft") for e in lexicon.entries) and "grob" in lexicon.entries
    assert not any(e.startswith("seltsam") for e in lexicon.entries)  # copies count once
    assert "edler lump" in lexicon.exceptions
    out = tx.scored(docs, lexicon)
    assert out.columns == ["doc_id", "text", "score", "n_hits", "score"]
    rows = tx.scored(docs.select("doc_id", "text"), lexicon).join(labels, "doc_id").withColumn("held_out", tx.fold("doc_id") == 0).filter("held_out").collect()
    assert len(rows) > 200 and sum((r.score >= 0.5) == (r.toxic == 1) for r in rows) / len(rows) > 0.97
    assert tx.fit(docs, labels) == lexicon  # the same again


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(spark, 400)
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(tx.fold("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tx.fit(docs, labels) == tx.fit(docs, flipped)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (99, 1)], "doc_id long, toxic int")
    lexicon = tx.fit(odd_docs, labels)
    rows = tx.scored(odd_docs, lexicon)
    assert rows.count() == odd_docs.count() and rows.columns == [*odd_docs.columns, "n_hits", "score"]
    assert all(0 <= r.score <= 1 for r in rows.collect())
    assert tx.scored(no_docs, tx.fit(no_docs, labels)).collect() == []


def test_whole_table(spark):
    out = tx.op13_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert out.count() == 1000 and out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.94
