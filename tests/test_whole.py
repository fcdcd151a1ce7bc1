"""Queries over batches of whole units: no token is shuffled, joined or staged, and the operators on tables say the same."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import agreement, batches, cascade, derivation, edges, frames, score, validate
from spanloom.plans import layers, whole
from spanloom.plans.catalogue import QUERIES
from spanloom.plans.queries import UNIT
from spanloom.sources import staging

SMALL = "/root/testdata/sf0.001"
#: Queries that read each text once.
ONCE = ["candidate_checks", "candidate_valid", "control_subjects", "exact_units", "fix_gains", "frame_repairs", "frame_violations", "morph_violations", "preposition_forms", "read_unit", "resolve_rows", "clean_units", "preposition_stacks", "guarded_walks", "case_supports", "span_soft_violations", "relative_antecedents", "agreement_verdict", "member_positions", "search_corpus", "derive_predicates", "set_diff_rows", "residual_violations", "rule_ablation", "repeated_spans", "derivation_census", "span_claims", "annex_alignment", "candidate_verdicts", "repair_fixpoint", "rule_census"]


@pytest.mark.parametrize("name", ONCE)
def test_one_pass(spark, monkeypatch, name):
    """Texts are dealt once, and the counts of a batch; nothing else is shuffled, nothing joined or written."""

    def fail(*_):
        raise AssertionError("tokens are staged")

    monkeypatch.setattr(staging, "shared_folder", fail)
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and plan.count("Exchange hashpartitioning") <= 3
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with short and long units, blank lines, elisions, letters of other scripts."""
    rng = random.Random(11)
    words = "era l' del vita, che Ciascuno n'è con ad ÀD Σ ὈΔΟΣ 'n tutto quanto 12 ... 'mpero vid'io là, İl ﬁn".split()
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + rng.choice([".", "", "", ";", "!"])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 40)))) for i in range(1, 40)] + [(40, " ".join(rng.choices(words, k=6000))), (41, ""), (42, None), (43, "...\n1")]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def rows_of(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def tokens(spark, odd):
    return layers.wide(spark, odd)


def test_layers_are_the_same(spark, tokens, odd):
    columns = ("line", "token", "word", "lemma", "pos", "deprel", "head", "number", "person", "gender", "note", "tense", "mood", "h", "width")

    def found(b):
        made = {c: getattr(b, c) for c in columns}
        return whole.placed(b, b.here) | {c: v.arrow() if isinstance(v, batches.Coded) else pa.array(v) for c, v in made.items()}

    coded = ("word", "lemma", "pos", "deprel", "number", "person", "gender", "note", "tense", "mood")
    schema = ", ".join([whole.KEYS, "u int", *(f"{c} {'string' if c in coded else 'long'}" for c in columns)])
    assert rows_of(layers.whole(spark, odd, found, schema), *UNIT, "u", *columns) == rows_of(tokens, *UNIT, "u", *columns)


def test_frames_are_the_same(spark, tokens, odd):
    schema = f"{whole.KEYS}, pred int, role string, arg int"
    columns = [*UNIT, "pred", "role", "arg"]
    cases = layers.case_rows(spark, odd, tokens)
    both = layers.frames_of(spark, odd, tokens)
    assert rows_of(layers.whole(spark, odd, lambda b: whole.frame_rows(b, b.frames), schema), *columns) == rows_of(derivation.frames(tokens, cases), *columns)
    assert rows_of(layers.whole(spark, odd, lambda b: whole.frame_rows(b, b.derived), schema), *columns) == rows_of(both.filter("NOT given"), *columns)
    assert rows_of(layers.whole(spark, odd, lambda b: whole.frame_rows(b, layers.given(b)), schema), *columns) == rows_of(both.filter("given"), *columns)


def test_pieces_hold_whole_units(spark, odd):
    part = pa.RecordBatch.from_pylist([{"words": [["a"] * n, [], ["b"]]} for n in (3, 0, 9, 1, 1, 40, 0)], pa.schema([("words", pa.list_(pa.list_(pa.string())))]))
    old, batches.TOKENS = batches.TOKENS, 12
    try:
        for cut in (part, part.slice(2, 4)):
            assert pa.concat_batches(list(layers._pieces(cut))).to_pylist() == cut.to_pylist()
        assert [p.num_rows for p in layers._pieces(part)] == [2, 2, 1, 1, 1]
    finally:
        batches.TOKENS = old


def test_checks_of_frames_are_the_same(spark, tokens, odd):
    from spanloom.plans import checks

    rows, heads = checks.moved_frames(spark, odd, tokens), layers.spans(spark, odd, tokens)
    want = validate.candidates(rows, tokens, heads, checks.canonical_cases(spark, odd, tokens)).groupBy("doc_id", "kind", "level").agg(F.count("*").alias("n"))
    assert rows_of(QUERIES["candidate_checks"](spark, odd), "doc_id", "kind", "level", "n") == rows_of(want, "doc_id", "kind", "level", "n")
    want = checks.by_kind(validate.frames(rows, tokens, heads, tuple(frames.ROLES)))
    assert rows_of(QUERIES["frame_violations"](spark, odd), "doc_id", "kind", "severity", "n") == rows_of(want, "doc_id", "kind", "severity", "n")
    both = layers.frames_of(spark, odd, tokens)
    classed = validate.classes(frames.divergence(both), tokens)
    want = validate.improved(classed, validate.slot_conflicts(classed)).groupBy("doc_id", "improved").agg(F.count("*").alias("n"))
    assert rows_of(QUERIES["fix_gains"](spark, odd), "doc_id", "improved", "n") == rows_of(want, "doc_id", "improved", "n")
    want = score.exact(both.filter("given"), both.filter("NOT given"), UNIT, ["pred", "role", "arg"]).groupBy("doc_id").agg(F.count("*").alias("units"), F.count_if("exact").alias("exact"))
    assert rows_of(QUERIES["exact_units"](spark, odd), "doc_id", "units", "exact") == rows_of(want, "doc_id", "units", "exact")
    want = frames.repairs(frames.divergence(both), agreement.agreement(tokens), edges.preposition_stacks(tokens))
    columns = [*UNIT, "pred", "kind", "arg", "role"]
    assert rows_of(QUERIES["frame_repairs"](spark, odd), *columns) == rows_of(want, *columns)


def test_walks_are_the_same(spark, tokens, odd):
    rows = derivation.frames(tokens, layers.case_rows(spark, odd, tokens))
    silent = rows.groupBy(*UNIT, F.col("pred").alias("u")).agg(F.bool_or(F.col("role") == "subj").alias("has")).filter("NOT has")
    columns = [*UNIT, "u", "candidate", "open"]
    assert rows_of(QUERIES["control_subjects"](spark, odd), *columns) == rows_of(cascade.control_subjects(tokens, rows, silent), *columns)
    assert rows_of(QUERIES["preposition_stacks"](spark, odd), *UNIT, "u", "lemmas") == rows_of(edges.preposition_stacks(tokens), *UNIT, "u", "lemmas")
    want = agreement.agreement(tokens).groupBy("verdict", "reason").agg(F.count("*").alias("n"))
    assert rows_of(QUERIES["agreement_verdict"](spark, odd), "verdict", "reason", "n") == rows_of(want, "verdict", "reason", "n")
    want = validate.clean(tokens, validate.edges(tokens)).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("units"))
    assert rows_of(QUERIES["clean_units"](spark, odd), "doc_id", "n", "units") == rows_of(want, "doc_id", "n", "units")


def test_rows_of_one_id_are_documents_of_their_own(spark, tmp_path):
    """Two rows with the same id, one after the other, are submitted as two documents."""
    rows = list(spark.read.parquet(f"{SMALL}/documents.parquet").limit(6).select("doc_id", "text").toLocalIterator())
    apart, twice = str(tmp_path / "apart"), str(tmp_path / "twice")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{apart}/documents.parquet")
    spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string").coalesce(1).write.parquet(f"{twice}/documents.parquet")
    columns = ("doc_id", "first_line", "valid", "n_errors", "n_warnings")
    once = rows_of(QUERIES["candidate_verdicts"](spark, apart), *columns)
    assert rows_of(QUERIES["candidate_verdicts"](spark, twice), *columns) == sorted(once * 2)
