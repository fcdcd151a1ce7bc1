"""Every rule accepts a row made for it and leaves the plain row of its kind alone."""

import pytest

from spanloom.operators import rules

PLAIN = {
    "doc_id": 1, "unit": 1, "pred": 2, "arg": 3, "role": "", "given_role": "", "a_deprel": "det", "a_pos": "article", "a_lemma": "x", "a_cases": [], "a_marks": [], "a_n_case": 1, "a_slots": [],
    "a_n_orphan": 0, "a_n_det": 0, "a_n_args": 1, "a_head": 9, "a_head_deprel": "root", "a_head_head": 0, "a_head_n_case": 0, "a_head_coord": 9, "hosted": True, "near": [],
    "p_deprel": "root", "p_pos": "verb", "p_lemma": "dire", "p_n_cop": 0, "p_aux_n_cop": 0, "p_n_complement": 0, "p_head": 0, "p_top_deprel": "root", "p_top_pos": "verb", "p_aux_pred": False, "p_aux_given": False,
    "derived_empty": False, "arg_given": False, "d": {3: "obj"}, "g": {4: "subj"},
}
TYPES = "doc_id int, unit int, pred int, arg int, role string, given_role string, a_deprel string, a_pos string, a_lemma string, a_cases array<string>, a_marks array<string>, a_n_case int, a_slots array<string>, "
TYPES += "a_n_orphan int, a_n_det int, a_n_args int, a_head int, a_head_deprel string, a_head_head int, a_head_n_case int, a_head_coord int, hosted boolean, near array<string>, p_deprel string, p_pos string, p_lemma string, "
TYPES += "p_n_cop int, p_aux_n_cop int, p_n_complement int, p_head int, p_top_deprel string, p_top_pos string, p_aux_pred boolean, p_aux_given boolean, derived_empty boolean, arg_given boolean, d map<int,string>, g map<int,string>, kind string"
DI = {"a_cases": ["di"]}
TWO = {"d": {3: "subj", 7: "subj"}}
CASES = {
    "CS": ("missing_tuple", {"derived_empty": True}),
    "AV": ("missing_tuple", {"p_aux_given": True}),
    "I": ("extra_tuple", {"p_aux_pred": True}),
    "Y": ("extra_tuple", {"p_deprel": "conj", "p_pos": "noun"}),
    "Z1": ("extra_tuple", {"p_deprel": "obj"}),
    "AY": ("extra_tuple", {"p_deprel": "amod", "p_pos": "adjective", "p_n_complement": 1}),
    "CH": ("extra_tuple", {"p_deprel": "conj", "p_top_deprel": "acl"}),
    "CY": ("missing_arg", {"role": "ccomp", "arg_given": True}),
    "Z2": ("missing_arg", {"role": "obj", "a_pos": "verb", "arg_given": True}),
    "BM": ("missing_arg", {"role": "obl:con", "a_pos": "adverb+conjunction"}),
    "AW": ("missing_arg", {"role": "obj", "a_deprel": "obj", "a_pos": "pronoun", "a_slots": ["dative", "reflexive"]}),
    "BX": ("missing_arg", {"role": "obl", "a_deprel": "obl", "a_pos": "adjective", "a_n_case": 0}),
    "DW": ("missing_arg", {"role": "xcomp", "a_deprel": "attr", "a_pos": "adjective", "a_n_case": 0}),
    "BA": ("missing_arg", {"role": "subj", **TWO, "g": {7: "subj"}}),
    "CW": ("missing_arg", {"role": "obj", "arg": 8, **TWO}),
    "DH": ("missing_arg", {"role": "obj", "arg": 5, **TWO, "g": {7: "subj"}}),
    "DI": ("missing_arg", {"role": "obj", "arg_given": True, "a_n_orphan": 1, "a_head": 2}),
    "AX1": ("missing_arg", {"role": "obj", "near": ["control given obj"]}),
    "BY": ("missing_arg", {"role": "obj", "near": ["aux given obj"]}),
    "L": ("role_mismatch", {"role": "obl", "given_role": "obl:di", "a_n_case": 0}),
    "M": ("role_mismatch", {"role": "obj", "given_role": "xcomp"}),
    "N": ("role_mismatch", {"role": "obj", "given_role": "obl:di", **DI}),
    "O": ("role_mismatch", {"role": "obl:con", "given_role": "obl:di", "a_cases": ["con", "di"]}),
    "P": ("role_mismatch", {"role": "ccomp", "given_role": "xcomp"}),
    "Q": ("role_mismatch", {"role": "obj", "given_role": "ccomp", "a_pos": "verb"}),
    "U": ("role_mismatch", {"role": "subj", "given_role": "obj", "a_pos": "pronoun", "a_slots": ["nominative"]}),
    "AL": ("role_mismatch", {"role": "obj", "given_role": "obl:a", "a_pos": "pronoun + pronoun"}),
    "AZ": ("role_mismatch", {"role": "obl", "given_role": "xcomp", "a_deprel": "obl", "a_pos": "noun", "a_n_case": 0}),
    "CQ": ("role_mismatch", {"role": "xcomp", "given_role": "obl:di", "a_marks": ["di"]}),
    "BD": ("role_mismatch", {"role": "obj", "given_role": "obl", "a_deprel": "obl", "a_pos": "pronoun", "a_slots": ["reflexive"]}),
    "DB": ("role_mismatch", {"role": "obl:in", "given_role": "xcomp", "a_deprel": "obl", "p_lemma": "essere"}),
    "J": ("extra_arg", {"given_role": "obl", "a_deprel": "advmod", "a_pos": "adverb"}),
    "R": ("extra_arg", {"given_role": "xcomp", "a_deprel": "advmod", "a_pos": "adjective"}),
    "S": ("extra_arg", {"given_role": "obl:di", "a_deprel": "nmod", **DI}),
    "T": ("extra_arg", {"given_role": "obl:di", "a_deprel": "advcl", **DI}),
    "AA": ("extra_arg", {"given_role": "ccomp", "a_deprel": "acl", "a_head": 3}),
    "AU": ("extra_arg", {"given_role": "xcomp", "a_deprel": "amod", "a_pos": "adjective", "a_head_coord": 3}),
    "BH": ("extra_arg", {"given_role": "subj", "arg": 0, "d": {3: "subj"}, "g": {3: "xcomp", 0: "subj"}}),
    "BI": ("extra_arg", {"given_role": "obj", "a_deprel": "nsubj", "a_head_deprel": "ccomp", "a_head_head": 2}),
    "BF": ("extra_arg", {"given_role": "xcomp", "a_deprel": "cop", "a_pos": "noun"}),
    "AB": ("extra_arg", {"given_role": "obj", "a_deprel": "expl", "a_pos": "pronoun"}),
    "AD": ("extra_arg", {"given_role": "xcomp", "a_deprel": "advmod", "a_pos": "adverb", "p_lemma": "essere"}),
    "AE": ("extra_arg", {"given_role": "obj", "a_deprel": "nsubj", "a_pos": "pronoun", "a_head": 3}),
    "BT": ("extra_arg", {"given_role": "obj", "a_pos": "pronoun", "a_lemma": "chi", "p_deprel": "acl:relcl", "p_head": 3}),
    "CT": ("extra_arg", {"given_role": "xcomp", "a_pos": "noun", "p_lemma": "essere", "p_head": 3}),
    "BW": ("extra_arg", {"given_role": "obj", "a_deprel": "mark", "a_pos": "pronoun"}),
    "AX2": ("extra_arg", {"given_role": "obj", "near": ["control derived obj"]}),
    "CG": ("extra_arg", {"given_role": "obj", "a_deprel": "amod", "a_head": 3, "a_head_n_case": 2}),
    "CC": ("extra_arg", {"given_role": "obj", "a_deprel": "conj", "a_pos": "noun", "a_head": 2, "a_n_args": 0}),
    "DA": ("extra_arg", {"given_role": "obj", "derived_empty": True}),
    "DD": ("extra_arg", {"given_role": "obl", "a_deprel": "case", "a_lemma": "onde", "a_head": 2}),
    "EA": ("extra_arg", {"given_role": "obj", "p_deprel": "parataxis", "p_pos": "noun", "d": {0: "subj"}}),
}
#: Rows close to an accepted one that must stay open.
REJECTED = {
    "BA": {"kind": "missing_arg", "role": "subj", **TWO, "g": {9: "subj"}},
    "CW": {"kind": "missing_arg", "role": "obj", "arg": 8, "d": {7: "subj"}},
    "AW": {"kind": "missing_arg", "role": "subj", "a_deprel": "obj", "a_pos": "pronoun", "a_slots": ["reflexive"]},
    "U": {"kind": "role_mismatch", "role": "subj", "given_role": "obj", "a_pos": "pronoun", "a_slots": ["nominative", "accusative"]},
    "DB": {"kind": "role_mismatch", "role": "obl:in", "given_role": "xcomp", "a_deprel": "obl", "p_lemma": "essere", "d": {5: "xcomp"}},
    "BF": {"kind": "extra_arg", "given_role": "xcomp", "a_deprel": "cop", "a_pos": "verb+noun"},
    "AE": {"kind": "extra_arg", "given_role": "subj", "a_deprel": "nsubj", "a_pos": "pronoun", "a_head": 3},
    "BW": {"kind": "extra_arg", "given_role": "obj", "a_deprel": "mark", "a_pos": "conjunction+pronoun"},
    "CC": {"kind": "extra_arg", "given_role": "obj", "a_deprel": "conj", "a_pos": "noun", "a_head": 2},
    "EA": {"kind": "extra_arg", "given_role": "obj", "p_deprel": "parataxis", "p_pos": "noun", "d": {0: "subj", 4: "obj"}},
}


@pytest.fixture(scope="module")
def hits(spark):
    rows = [{**PLAIN, "kind": kind, **cells, "doc_id": i} for i, (kind, cells) in enumerate(CASES.values())]
    rows += [{**PLAIN, "kind": k, "role": "obj", "given_role": "subj", "doc_id": 100 + i} for i, k in enumerate(("missing_tuple", "extra_tuple", "missing_arg", "role_mismatch", "extra_arg"))]
    rows += [{**PLAIN, **cells, "doc_id": 200 + i} for i, cells in enumerate(REJECTED.values())]
    df = spark.createDataFrame(rows, TYPES)
    return df, {r.doc_id: r.hits for r in rules.with_hits(df).collect()}


def test_the_catalogue_is_covered():
    assert list(CASES) == list(rules.CONDITIONS)


@pytest.mark.parametrize(("i", "rule"), list(enumerate(CASES)))
def test_accepts(hits, i, rule):
    assert rule in hits[1][i]


@pytest.mark.parametrize(("i", "rule"), list(enumerate(REJECTED)))
def test_rejects(hits, i, rule):
    assert rule not in hits[1][200 + i]


def test_plain_rows_stay_open(hits):
    assert [hits[1][100 + i] for i in range(5)] == [[]] * 5


@pytest.mark.parametrize("rule", ["M", "J", "CS"])
def test_ablation(hits, rule):
    """A rule that is off no longer accepts, and the one pass over all rules counts the same."""
    df, found = hits
    off = {r.doc_id for r in rules.judged(df, (rule,)).filter("rule_id = ''").collect()}
    assert off == {i for i, h in found.items() if not [x for x in h if x != rule]}
    counted = {(r.disabled, r.kind): r.n for r in rules.ablation(df).collect()}
    assert sum(n for (d, _), n in counted.items() if d == rule) == len(off)


def test_census(hits):
    df, found = hits
    got = {r.rule_id: (r.hits, r.sole) for r in rules.census(df).collect()}
    assert set(got) == set(rules.CONDITIONS)
    assert all(got[r] == (sum(r in h for h in found.values()), sum(h == [r] for h in found.values())) for r in got)
