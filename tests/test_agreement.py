"""One unit for every branch of agreement, with the verdict worked out by hand, and small rows for validators."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as fn
from spanloom.operators import agreement, score, validate
from spanloom.operators.edges import conjunct_resolves, preposition_stacks
from spanloom.sources import text as src

COLUMNS = "doc_id long, unit long, u int, n int, word string, pos string, lemma string, number string, person string, note string, tense string, mood string, head int, deprel string"
VERB = {"pos": "verb", "number": "sg.", "person": "3", "tense": "present", "mood": "indicative", "deprel": "root"}
NOUN = {"pos": "noun", "number": "sg.", "head": 1, "deprel": "nsubj"}
WE = {**VERB, "number": "pl.", "person": "1"}
THEY = {**VERB, "number": "pl."}

#: Head, subject, further tokens; verdict and reason.
BRANCHES = [
    ([{**VERB, "person": ""}, NOUN], "undecidable", "head not finite"),
    ([{**VERB, "pos": "noun"}, NOUN], "undecidable", "head not finite"),
    ([{**VERB, "pos": "verb+pronoun", "tense": "", "mood": ""}, NOUN], "undecidable", "fused token"),
    ([VERB, {**NOUN, "pos": "adverb+pronoun"}], "undecidable", "fused token"),
    ([VERB, {**NOUN, "lemma": "che", "number": "pl."}], "undecidable", "person of the antecedent"),
    ([WE, {**NOUN, "pos": "pronoun", "person": "1"}], "undecidable", "member of a plural"),
    ([WE, NOUN], "disagree", "person"),
    ([VERB, NOUN, {**NOUN, "deprel": "nsubj:pass"}], "undecidable", "several subjects"),
    ([THEY, {**NOUN, "note": "x, AD_SENSUM"}], "undecidable", "exempt"),
    ([{**THEY, "note": "FOREIGN"}, NOUN], "undecidable", "exempt"),
    ([THEY, {**NOUN, "lemma": "ciascuno"}], "undecidable", "distributive"),
    ([{**VERB, "person": "1"}, NOUN, {"pos": "pronoun", "person": "1", "head": 2, "deprel": "conj"}], "undecidable", "coordinated subject"),
    ([{**VERB, "person": "1"}, NOUN, {"pos": "noun", "head": 2, "deprel": "conj"}, {"pos": "pronoun", "person": "1", "head": 3, "deprel": "conj"}], "undecidable", "coordinated subject"),
    ([WE, NOUN, {"pos": "noun", "head": 2, "deprel": "conj"}], "disagree", "person"),
    ([{**VERB, "person": "2"}, NOUN], "disagree", "person"),
    ([THEY, NOUN, {"head": 2, "deprel": "cc"}, {"pos": "noun", "head": 2, "deprel": "nmod"}], "undecidable", "coordination inside the subject"),
    ([THEY, NOUN, {"pos": "noun", "head": 1, "deprel": "obl"}, {"pos": "preposition", "lemma": "con", "head": 3, "deprel": "case"}], "undecidable", "comitative phrase"),
    ([VERB, {**NOUN, "number": "pl."}, {"head": 2, "deprel": "nummod"}], "undecidable", "quantified subject"),
    ([VERB, {**NOUN, "number": "pl."}, {"lemma": "molto", "head": 2, "deprel": "amod"}], "undecidable", "quantified subject"),
    ([THEY, NOUN, {"pos": "noun", "number": "pl.", "head": 1, "deprel": "attr"}], "undecidable", "predicate nominal"),
    ([VERB, {**NOUN, "number": "pl."}, {"head": 1, "deprel": "expl:impers"}], "undecidable", "impersonal"),
    ([VERB, {**NOUN, "number": "pl."}, {"note": "impersonal", "head": 1, "deprel": "expl"}], "undecidable", "impersonal"),
    ([THEY, NOUN], "disagree", "number"),
    ([VERB, NOUN], "agree", ""),
    ([VERB, {**NOUN, "number": ""}], "agree", ""),
]


def units(spark, rows):
    blank = {"word": "w", "pos": "x", "lemma": "l", "number": "", "person": "", "note": "", "tense": "", "mood": "", "head": 0, "deprel": "root"}
    return spark.createDataFrame([{**blank, **t, "doc_id": 1, "unit": i, "u": k, "n": len(unit)} for i, unit in enumerate(rows) for k, t in enumerate(unit, 1)], COLUMNS)


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = agreement.agreement(units(spark, [b[0] for b in BRANCHES])).filter("subject = 2").collect()
    return {r.unit: (r.verdict, r.reason) for r in rows}


@pytest.mark.parametrize("i", range(len(BRANCHES)))
def test_branch(verdicts, i):
    assert verdicts[i] == BRANCHES[i][1:]


def test_cases_against_relations(spark):
    rows = [("accusative", "obj", "agree"), ("dative", "obj", "contradict"), ("reflexive", "obj", "open"), ("nominative", "obl", "impossible"), ("ablative", "obl", "open"), ("accusative+dative", "iobj", "agree"), ("genitive", "nsubj", "open")]
    cases = spark.createDataFrame([(1, i, 1, c) for i, (c, _, _) in enumerate(rows)], "doc_id long, unit long, u int, case string")
    edges = spark.createDataFrame([(1, i, 1, r) for i, (_, r, _) in enumerate(rows)], "doc_id long, unit long, u int, deprel string")
    got = agreement.adjudicated(cases, edges)
    assert {r.unit: r.verdict for r in got.collect()} == {i: v for i, (_, _, v) in enumerate(rows)}
    assert {r.deprel: (r.agree, r.contradict, r.rate) for r in agreement.agreement_rates(got).collect()} == {"obj": (1, 1, 0.5), "iobj": (1, 0, 1.0), "nsubj": (0, 0, 0.0)}


def test_edges_and_units(spark):
    ring = [{"head": 2, "deprel": "obj"}, {"head": 1, "deprel": "obl"}]
    away = [{"head": 9, "deprel": "obj"}, {}, {"head": 3, "deprel": "weird"}]
    odd = [{"deprel": "obj"}, {"head": 1, "deprel": "obj"}, {"head": 1, "deprel": "obj"}, {"head": 1, "deprel": "acl:relcl"}, {}]
    df = units(spark, [ring, away, odd])
    got = {}
    for r in validate.edges(df).collect():
        got.setdefault(r.unit, []).append((r.u, r.kind))
    assert sorted(got[0]) == [(0, "no_root"), (1, "cycle"), (2, "cycle")]
    assert sorted(got[1]) == [(1, "not_in_unit"), (3, "cycle"), (3, "self_head"), (3, "vocabulary")]
    assert sorted(got[2]) == [(0, "many_roots"), (1, "root_label"), (1, "several_objects"), (4, "relative_head")]
    assert validate.clean(df, validate.edges(df)).count() == 0


def test_candidates(spark):
    t = units(spark, [[{"pos": "verb"}, {"pos": "noun"}, {"pos": "pronoun + pronoun"}, {"pos": "article"}]]).withColumn("line", F.lit(1)).withColumn("token", F.col("u"))
    heads = spark.createDataFrame([(1, 1, 2)], "doc_id long, line int, head int")
    cases = spark.createDataFrame([(1, 0, 3, "dative+accusative")], "doc_id long, unit long, u int, case string")
    rows = [("subj", 2), ("obj", 3), ("obl:a", 3), ("obj", 4), ("ccomp", 4), ("strange", 2), ("obj", 9), ("obj", 9), ("", 2)]
    df = spark.createDataFrame([(1, 0, 1, r, a) for r, a in rows], "doc_id long, unit long, pred int, role string, arg int")
    got = sorted((r.kind, r.level) for r in validate.candidates(df, t, heads, cases).collect())
    want = ["anchor", "argument", "argument", "dual_role", "dual_role", "role", "slot", "zero_coexists", "zero_marker"]
    assert got == sorted([(k, "error") for k in want] + [("role_repeated", "warning")])


def test_cells_and_answers(spark):
    df = spark.createDataFrame([("-", ""), (" n/a ", ""), ("**x y**", "x y"), ("x*", "x"), ("*x**", "*x**"), ("m.", "m.")], "cell string, want string")
    assert df.filter(fn.fixed_cell(F.lit("note"), F.col("cell")) != F.col("want")).count() == 0
    note = spark.createDataFrame([("N1: a  b\nno\n N2.3) c ",)], "t string").select(F.inline(fn.field_notes(F.col("t"))))
    assert [tuple(r) for r in note.collect()] == [(1, None, "a b"), (2, 3, "c")]
    line = spark.createDataFrame([("e l'altro, sì",)], "t string")
    assert line.select(fn.marked_text(F.col("t"), F.array(F.lit(2), F.lit(4)))).first()[0] == "e **l'**altro, **sì**"
    assert spark.range(1).select(fn.normal_preposition(F.lit("del")), fn.normal_preposition(F.lit("x"))).first()[:] == ("di", "x")


def test_chains(spark):
    df = units(spark, [[{}, {"head": 1, "deprel": "conj"}, {"head": 2, "deprel": "conj"}, {"head": 5, "deprel": "conj"}, {"head": 4, "deprel": "conj"}], [{}, {"word": "del", "head": 1, "deprel": "case"}, {"word": "su", "head": 2, "deprel": "case"}, {"word": "per", "head": 2, "deprel": "fixed"}]])
    resolves = {(r.unit, r.u): r.resolves for r in conjunct_resolves(df, ("root",)).collect()}
    assert resolves == {(0, 2): True, (0, 3): True, (0, 4): False, (0, 5): False}
    assert {(r.unit, r.u): r.lemmas for r in preposition_stacks(df).collect()} == {(1, 1): "di+per+su", (1, 2): "per+su"}


def test_scores(spark):
    gold = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "a", 1)], "pred int, role string, arg int")
    made = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 1), (2, "b", 1, 1), (2, "a", 1, 2), (4, "a", 1, 2)], "pred int, role string, arg int, submission int")
    assert {r.pred: r.passed for r in score.first_passes(made, gold, ["pred"], ["role", "arg"]).collect()} == {1: True, 2: False, 3: False}
    assert sorted((r.pred, r.role) for r in score.accumulated(made, ["pred"]).collect()) == [(1, "a"), (1, "b"), (2, "a"), (4, "a")]
    row = score.micro_macro(spark.createDataFrame([("a", 2, 0, 2), ("b", 0, 1, 0)], "role string, tp long, fp long, fn long")).first()
    assert (row.precision, row.recall, row.macro_f1) == (0.6667, 0.5, 0.3334) or row.macro_f1 == 0.3333


def test_ranges_of_lines(spark):
    rows = src.lines(spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb")], "doc_id long, text string"))
    assert [(r.doc_id, r.line) for r in src.line_range(rows, 2, 3).orderBy("line").collect()] == [(1, 2), (1, 3)]
    for bad in ((0, 2), (3, 2)):
        with pytest.raises(ValueError):
            src.line_range(rows, *bad)


def test_references(spark):
    assert src.parsed_reference("one 3") == ("one", 3, None, None) and src.parsed_reference(" one 3:2-4") == ("one", 3, 2, 4) and src.parsed_reference("one 3:2") == ("one", 3, 2, 2)
    for bad in ("one", "3:1", "one 3:4-2", "one 3:0", "one 3:1-"):
        with pytest.raises(ValueError):
            src.parsed_reference(bad)
    rows = spark.createDataFrame([("one", 3, i, "x") for i in range(1, 6)] + [("two", 3, 1, "y")], "group string, doc_no int, line int, text string")
    assert [r.line for r in src.referred(rows, "one 3:2-3").orderBy("line").collect()] == [2, 3] and src.referred(rows, "one 3").count() == 5


def test_search_refuses(spark):
    from spanloom.operators.search import search

    df = spark.createDataFrame([(1, 1, 1, "w")], "doc_id long, line int, token int, word string")
    assert search(df, {"word": "w,"}, 5).count() == 1 and search(df, {"word": "w"}, 5, without=1).count() == 0
    for query, limit in (({"colour": "x"}, 5), ({}, 5), ({"word": "w"}, 0)):
        with pytest.raises(ValueError):
            search(df, query, limit)
