import hashlib
import random

import pytest

from spanloom.llm import substring


def brute(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        cut = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                cut[k : k + 20] = [True] * 20
            seen.add(window)
        out[i] = (len(words), sum(cut), hashlib.sha256(b" ".join(w for w, c in zip(words, cut, strict=True) if not c)).hexdigest())
    return out


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op10_substring_dedup(spark, str(tmp_path)).collect()}


def periodic(seed):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["a a a", "b", "a b a b", "c"]) for _ in range(r.randint(0, 100)))) for i in range(40)] + [(100, "x " * 500), (101, "x " * 30), (102, "x y " * 50), (103, "y x " * 50), (104, None), (105, "")]


def shared(seed):
    r = random.Random(seed)
    passages = [" ".join(f"p{k}{i}" for i in range(r.choice((19, 20, 21, 60)))) for k in range(6)]
    return [(i, " ".join(r.choice([*passages, f"w{r.randint(0, 9)}", f"u{r.random()}"]) for _ in range(12))) for i in range(60)]


@pytest.mark.parametrize("rows", [periodic(1), shared(2)], ids=["periodic", "shared"])
def test_against_brute_force(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == brute(rows)


def test_many_rounds_of_settling(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substring, "HELD", 50)
    rows = shared(3)
    assert run(spark, rows, tmp_path) == brute(rows)


def test_whole_table(spark, small):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.op10_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    want = brute(small)
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_odd_rows(spark, odd_docs, no_docs):
    rows = substring.removed(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_words, r.n_removed) for r in rows if r.doc_id == 0} == {(12, 0)}
    assert next(r.n_removed for r in rows if r.doc_id == 5) == 60_000 - 977 - 19 + 19
    assert substring.removed(no_docs).collect() == []


def test_repeated_rows_are_one_document(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, text)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_removed) for r in substring.op10_substring_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == [(1, 30), (1, 30), (2, 30), (None, 0)]
