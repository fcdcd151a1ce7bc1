"""Units that stay together from the text on: no shuffle of tokens, and units that batches cut."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.operators import derivation, edges, units
from spanloom.plans import layers
from spanloom.sources import text as src

SMALL = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_tokens_are_not_shuffled(spark):
    """Only the texts are."""
    assert shuffles(layers.facts(spark, SMALL)) == 1


def test_groups_equal_the_window(spark):
    texts = ["a.\nb\n\n  \nc! \nd", "one", "", " \n\n", None, "x 1 2.\n. \ny?\n\nz."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = units.grouped(docs).select("doc_id", "unit", F.inline("lines"))
    want = units.sentence_groups(src.lines(docs)).select("doc_id", "unit", "line", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 9


@pytest.mark.parametrize("together", [False, True])
def test_batches_cut_units(spark, together):
    sizes = [1, 7, 2, 30, 1, 1, 5]
    rows = [(1, k, u) for k, n in enumerate(sizes) for u in range(1, n + 1)]
    df = spark.createDataFrame(rows, "doc_id long, unit long, u int").coalesce(1)

    def found(columns, base, longest):
        return {"size": pa.array(np.bincount(base, minlength=len(base))[base])}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = edges.by_unit(df, edges.UNIT, [T.StructField("size", T.LongType())], found, together).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(tuple(r) for r in got) == [(*r, sizes[r[1]]) for r in sorted(rows)]


def test_children_beyond_the_unit_do_not_count(spark):
    rows = [(1, 1, 1, 0, "root", "verb", "a", "3"), (1, 1, 2, 1, "case", "noun", None, ""), (1, 1, 3, 1, "case", "noun", "c", ""), (1, 1, 4, 9, "obj", "noun", "d", "")]
    df = spark.createDataFrame(rows, "doc_id long, unit long, u int, head int, deprel string, pos string, lemma string, person string")
    got = {r.u: r for r in derivation._children(df, edges.UNIT).collect()}
    assert (got[1].has_case, got[1].prep, got[1].n_args, got[1].first_subj, got[1].conj_subj) == (True, None, 0, 0, 2147483647)
    assert sum(r.n_args for r in got.values()) == 0


@pytest.mark.parametrize("name", ["head_word_join", "dep_children", "dep_multi_obj", "derive_args", "derive_predicates", "subtree_starts", "bounded_walks"])
def test_edge_queries_shuffle_texts_only(spark, name):
    from spanloom.plans.queries import QUERIES

    assert shuffles(QUERIES[name](spark, SMALL)) == 1


def test_lines_go_on_in_the_next_file_of_a_layer(spark, tmp_path):
    rows = [("a", d, 1, t, f"w{t}") for d in (1, 2) for t in range(1, 24)]
    df = spark.createDataFrame(rows, "shelf string, doc_id long, line int, token int, word string")
    src.write_layer(df, str(tmp_path / "layer"), ["doc_id", "line", "token"], ["shelf"], most=2)
    files = list((tmp_path / "layer").glob("shelf=*/*.csv"))
    assert len(files) >= 23 and all(len(f.read_text().splitlines()) <= 3 for f in files)
    back = src.numbered_tokens(src.read_layer(spark, str(tmp_path / "layer/*/*.csv"), ["doc_id", "line", "token_", "word"]), ("doc_id", "line"))
    assert sorted((int(r.doc_id), r.token, r.word) for r in back.collect()) == [(d, t, w) for _, d, _, t, w in rows]


def test_parts_of_long_groups(spark):
    """Groups of up to 20,000 lines, cut as a plain loop does; arrays that grew at each step took minutes."""
    import random
    import time

    draw = random.Random(3)
    flags = [[draw.random() < p for _ in range(n)] for n, p in ((1, 0.0), (12, 0.5), (13, 0.0), (200, 0.05), (20000, 0.1))]
    rows = [(d, 1, k, "x;" if soft else "x") for d, group in enumerate(flags) for k, soft in enumerate(group)]
    df = spark.createDataFrame(rows, "doc_id long, unit int, line int, text string").repartition(3)
    began = time.time()
    got = {(r.doc_id, r.line): r.part for r in units.split_long(df).collect()}
    assert time.time() - began < 60
    for d, group in enumerate(flags):
        at, part, want = 0, 1, []
        while len(group) - at > 12:
            taken = max((k + 1 for k in range(12) if group[at + k]), default=12)
            want += [part] * taken
            at, part = at + taken, part + 1
        want += [part] * (len(group) - at)
        assert [got[d, k] for k in range(len(group))] == want


def test_marks_in_long_lines(spark):
    import time

    from spanloom.functions import text as fn

    lines = ["'tis a b' c!", "", " -- ", "é'l x"]
    got = spark.createDataFrame([(t,) for t in lines], "t string").select(fn.marked_text(F.col("t"), F.array(F.lit(1), F.lit(3)))).collect()
    assert [r[0] for r in got] == ["**'tis** a **b'** c!", "", " -- ", "**é'**l **x**"]
    numbers = F.transform(fn.alpha_tokens(F.col("t")), lambda _, k: k + 1)
    began = time.time()
    long = spark.createDataFrame([("ab, " * 5000,)], "t string").select(fn.marked_text(F.col("t"), numbers)).first()[0]
    assert long == "**ab**, " * 5000 and time.time() - began < 30
