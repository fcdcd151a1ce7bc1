from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import quality


def brute(text):
    raw = (text or "").encode()
    words = raw.split()
    seen = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {k + j for k in range(len(words) - 4) if seen[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in raw.split(b"\n") if x.split()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit), len(lines))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.none(), st.text("ab#\n\t é ", max_size=80), st.lists(st.sampled_from(["a", "b", "c"]), max_size=60).map(" ".join)))
def test_signals(text):
    assert quality.measure(text) == brute(text)


def test_whole_table(spark, small):
    got = {r.doc_id: r for r in quality.op7_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    for i, text in small:
        n, chars, symbols, dup, repeat, _ = brute(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.kept and r.base_failed)


CLEAN = "word0 word1 word2 word3 word4 word5 word6 word7 word8 word9 word10"
NOISY = " ".join(f"w{i}###" for i in range(12))


def hosts(spark):
    rows = [(i, NOISY, "bad") for i in range(50)] + [(50, CLEAN, "bad"), (51, CLEAN, "good"), (52, NOISY, "good"), (53, CLEAN, None), (54, "short", "good")]
    rows += [(i, CLEAN + f" x{i}", "good" if i % 2 else f"h{i % 8}") for i in range(60, 140)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_a_rejected_host_goes_with_its_documents(spark):
    df = hosts(spark)
    rows = {r.doc_id: r for r in quality.quality_report(df).collect()}
    assert all(rows[i].host_rejected and not rows[i].kept and rows[i].host_rate > 0.8 for i in range(51))
    assert rows[51].kept and rows[52].kept and rows[53].kept and not rows[54].kept and not rows[52].host_rejected
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, r in rows.items() if r.kept}


def test_sql_with_a_rejected_host(spark, tmp_path):
    """The SQL of the query over hosts of which one is rejected."""
    from oracle import differences

    from spanloom.llm.oracle import SQL

    hosts(spark).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert differences(spark, str(tmp_path), quality.op7_quality_rules, SQL["op7_quality_rules"]) == ""


def test_threshold_follows_the_prior():
    assert quality.threshold(1, 99) == quality.SPARED and quality.threshold(0.1, 0.1) == 0.75 and quality.threshold(0.1, 0.9) == quality.HOPELESS
    m, d = 0.3, (0.3 * 0.7 / 101) ** 0.5
    assert abs(quality.threshold(30, 70) - (m + 3 * d)) < 1e-12


def test_clashing_names(spark):
    names = ["__signals", "__rejected", "__failed", "__base_failed", "host", "own", "failed", "n_words", "host_rate", "measured", "c0", "kept"]
    df = hosts(spark).selectExpr("*", *(f"'v{i}' AS `{n}`" for i, n in enumerate(names)))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == quality.keep_good(hosts(spark)).count()
    assert tuple(kept.first())[3:] == tuple(f"v{i}" for i in range(len(names)))


def test_odd_rows(spark, odd_docs, no_docs):
    assert quality.quality_report(odd_docs).count() == odd_docs.count()
    kept = quality.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == [0, 0, 0, 1, 7]
    assert quality.quality_report(no_docs).collect() == [] and quality.keep_good(no_docs).collect() == []


def test_shrinkage(spark):
    counts = spark.createDataFrame([("a", 1, 1), ("b", 1000, 900), ("c", 1000, 10), ("d", 1000, 12)], "host string, n long, fails long")
    rate = {r["host"]: r["host_rate"] for r in quality.host_verdicts(counts).collect()}
    assert rate["a"] < 1 and abs(rate["b"] - 0.9) < 0.01 and rate["c"] < rate["d"] < 0.02
