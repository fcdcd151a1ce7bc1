"""Rewrites to a fixpoint, against a plain loop over units."""

import random

from pyspark.sql import functions as F

from spanloom.operators import frames as fr
from spanloom.operators import repair
from spanloom.operators.edges import UNIT


def judge(given, wanted):
    """Differences, and a class of its own for two rows of one role."""
    found = fr.divergence(fr.sided(given, wanted)).withColumn("class", F.col("kind"))
    twice = given.filter("role LIKE 'obl:%'").groupBy(*UNIT, "pred", "role").count().filter("count > 1")
    return found.union(twice.select(*UNIT, "pred", F.lit(0).alias("arg"), F.lit("repeat").alias("kind"), "role", F.lit("").alias("given_role"), F.lit("repeat").alias("class")))


def rewrites(found):
    label = found.filter("kind = 'role_mismatch' AND given_role = 'obl'").select(*UNIT, "pred", F.lit("role_label").alias("kind"), "arg", "role")
    return label.union(fr.null_subject_repairs(found).select(*UNIT, "pred", F.lit("null_subject").alias("kind"), "arg", F.lit("subj").alias("role")))


def plain_judge(given, wanted):
    out = []
    for p in {x[0] for x in given} | {x[0] for x in wanted}:
        g, d = {a: r for q, r, a in given if q == p}, {a: r for q, r, a in wanted if q == p}
        if not g or not d:
            out.append(("missing_tuple" if d else "extra_tuple", p, 0, "", ""))
            continue
        for a in set(g) | set(d):
            if a not in g:
                out.append(("missing_arg", p, a, d[a], ""))
            elif a not in d:
                out.append(("extra_arg", p, a, "", g[a]))
            elif g[a] != d[a]:
                out.append(("role_mismatch", p, a, d[a], g[a]))
        roles = [r for r in g.values() if r.startswith("obl:")]
        out += [("repeat", p, 0, r, "") for r in set(roles) if roles.count(r) > 1]
    return out


def plain(given, wanted):
    tried, log = set(), []
    while True:
        found = plain_judge(given, wanted)
        options = []
        for p in {x[1] for x in found}:
            mine = [x for x in found if x[1] == p]
            options += [(p, 1, a, new, ("role_label", p, "obl", a)) for kind, _, a, new, old in mine if kind == "role_mismatch" and old == "obl"]
            miss = [a for kind, _, a, role, _ in mine if kind == "missing_arg" and role == "subj" and a]
            if len(miss) == 1 and sum(kind == "extra_arg" and a == 0 and old == "subj" for kind, _, a, _, old in mine) == 1:
                options.append((p, 0, miss[0], "subj", ("null_subject", p, "subj", 0)))
        options = sorted(x for x in options if x[4] not in tried)
        if not options:
            return sorted(log)
        p, _, a, new, what = options[0]
        tried.add(what)
        after = [(p, new, a) if x == (p, what[2], what[3]) else x for x in given]
        then = plain_judge(after, wanted)
        good = len(then) < len(found) and {x[0] for x in then} <= {x[0] for x in found}
        log.append((p, what[0], new, a, good))
        given = after if good else given


def test_fixpoint(spark):
    rng = random.Random(6)
    given, wanted, want = [], [], {}
    for unit in range(80):
        d, g = {}, {}
        for p in (1,):
            for a in rng.sample(range(3, 9), 3):
                d[p, a] = rng.choice(["subj", "obl:a", "obl:di", "obl:a", "obj"])
                g[p, a] = rng.choice([d[p, a], d[p, a], "obl", "obl:a"])
            if rng.random() < 0.5:
                subj = [a for (q, a), r in d.items() if q == p and r == "subj"]
                if subj:
                    g.pop((p, subj[0]))
                    g[p, 0] = "subj"
        rows = lambda m: [(p, r, a) for (p, a), r in m.items()]
        given += [(1, unit, *x) for x in rows(g)]
        wanted += [(1, unit, *x) for x in rows(d)]
        want[unit] = plain(rows(g), rows(d))
    kind = "doc_id long, unit int, pred int, role string, arg int"
    got = {}
    for r in repair.fixpoint(spark.createDataFrame(given, kind), spark.createDataFrame(wanted, kind), judge, rewrites).collect():
        got.setdefault(r.unit, []).append((r.pred, r.kind, r.role, r.arg, r.kept))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    kept = [x[4] for v in want.values() for x in v]
    assert kept.count(True) > 10 and kept.count(False) > 1
