"""Queries whose steps need no shuffle of tokens, and walks in time in proportion to their chunk."""

import random
import time

from pyspark.sql import functions as F

from spanloom.operators import agreement, align, edges, frames, spans, validate
from spanloom.plans import layers, queries

SMALL = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_one_pass_over_units(spark):
    """Texts are shuffled, tokens are not."""
    t, facts = layers.edges(spark, SMALL), layers.facts(spark, SMALL)
    made = [edges.structure_violations(t, together=True), edges.conjunct_clusters(t, together=True), edges.conjunct_resolves(t, frames.CLAUSES, together=True)]
    made += [agreement.agreement(facts, together=True), validate.edges(facts, together=True), agreement.judged(queries.cases_with_relation(spark, SMALL))]
    assert [shuffles(df) for df in made] == [1] * len(made)


def test_frames_are_dealt_once(spark):
    rows = spark.createDataFrame([(1, 1, 1, "subj", 0, True)], "doc_id long, unit int, pred int, role string, arg int, given boolean")
    assert shuffles(frames.divergence(rows)) == 1


def test_several_objects_beyond_the_unit(spark):
    kinds = "doc_id long, unit int, u int, head int, deprel string, pos string, lemma string, number string, person string, note string, tense string, mood string, n int"
    rows = [(1, 1, u, h, r, "noun", "", "sg.", "", "", "", "", 3) for u, h, r in ((1, 0, "root"), (2, 9, "obj"), (3, 9, "obj"))]
    got = {(r.u, r.kind) for r in validate.edges(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {(2, "not_in_unit"), (3, "not_in_unit"), (9, "several_objects")}


def test_words_of_a_line_are_not_joined(spark):
    assert "Join" not in queries.QUERIES["loose_word_match"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_next_rows_take_linear_time():
    n = 100_000
    want = [{"word": f"word{i}", "bare": f"word{i}"} for i in range(n)]
    rows = [{"row": i, "left": f"other{i}" if i % 2 else f"word{i}", "bare": f"other{i}" if i % 2 else f"word{i}"} for i in range(n)]
    began = time.time()
    assert align.next_rows(want, rows) == [None if i % 2 else i + 1 for i in range(n)]
    assert time.time() - began < 20


def test_next_rows_equal_the_scan(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab*,") for _ in range(rng.randint(1, 5)))
    targets = [(k, i, word()) for k in range(40) for i in range(6)]
    table = [(k, rng.randint(0, 8), word(), "acc.") for k in range(40) for _ in range(10)]
    got = {(r.unit, r.at): r.row for r in align.annex_rows(spark.createDataFrame(targets, "unit int, at int, word string"), spark.createDataFrame(table, "unit int, row int, word string, case string"), ["unit"]).collect()}
    pairs = [(a, b) for k in range(40) for _, _, a in targets[k * 6 : k * 6 + 6] for _, _, b, _ in table[k * 10 : k * 10 + 10]]
    df = spark.createDataFrame(pairs, "t string, w string").distinct()
    same = {(r.t, r.w) for r in df.filter(align.names_token(F.col("w"), F.col("t"))).collect()}
    for k in range(40):
        last = -1
        for _, at, t in targets[k * 6 : k * 6 + 6]:
            hit = min((r for _, r, w, _ in table[k * 10 : k * 10 + 10] if r > last and (t, w) in same), default=None)
            assert got[k, at] == hit
            last = last if hit is None else hit


def test_many_spans_in_a_line(spark):
    """Disjoint spans of one line are not compared pairwise."""
    rng = random.Random(5)
    rows = [(1, 1, s, s + rng.randint(0, 4), s) for s in rng.choices(range(1, 60), k=80)] + [(1, 2, s, s, s) for s in range(1, 30_001)]
    df = spark.createDataFrame(rows, "doc_id long, line int, start int, end int, head int")
    assert "Join" not in spans.nested(df)._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in spans.nested(df).filter("line = 1").select("ord", "start", "end", "parent").collect())
    for o, s, e, parent in got:
        outer = [p for p, a, b, _ in got if p < o and a <= s and e <= b and (a, b) != (s, e)]
        assert parent == max(outer, default=0)
    assert spans.nested(df).filter("line = 2 AND parent = 0").count() == 30_000


def test_texts_are_dealt_in_bounded_parts(spark, tmp_path):
    """Large parts of texts are split whatever the number of shuffle partitions is."""
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    held = {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        parts = layers.words(spark, str(tmp_path)).select(F.spark_partition_id().alias("part")).distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert parts > 1


def test_pronouns_are_counted_in_their_document(spark, tmp_path):
    df = queries.QUERIES["coverage_left_join"](spark, SMALL)
    assert shuffles(df) == 1 and "Join" not in df._jdf.queryExecution().executedPlan().toString()
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(["era", "l'", "...", "a.", "vita,", "12", ""]) for _ in range(rng.randint(0, 9)))
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 12)))) for i in [1, 2, 3, 4, 4, 5, 5, 5, 8, None, None]] + [(6, None), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    cases = {}
    for r in layers.case_rows(spark, str(tmp_path)).collect():
        cases[r.doc_id, r.line] = cases.get((r.doc_id, r.line), 0) + 1
    lines = [(i, n) for i, t in rows for n, x in enumerate((t or "").split("\n"), 1) if x.strip(" ")]
    got = [tuple(r) for r in queries.QUERIES["coverage_left_join"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(((i, n, cases.get((i, n), 0)) for i, n in lines), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
