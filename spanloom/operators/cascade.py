"""Given and derived frames brought to one notation before they are compared.

Both sides are maps from argument to role for each predicate, held as rows ``(unit keys, pred, arg, role,
ord, given)``. First the authority over subjects drops those that only one side can know (``authority``);
then arguments are named anew, step by step in a fixed order, and equal names meet (``cascade``):

    auxiliary -> its verb, stacked preposition -> its nominal, member of an adverb cluster -> its host,
    conjunct -> head of the coordination, phrase head <-> attachment, floating quantifier -> its nominal,
    and obliques of other arguments' nominals go.

Each step is one grouping by predicate and argument. Rows of a predicate meet only each other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import canonical_role, role_rank
from spanloom.operators.agreement import agreement
from spanloom.operators.derivation import SUBJECTS, UNIT, with_facts
from spanloom.operators.edges import FUNCTION, WALK, by_unit, guarded_walks
from spanloom.sources.staging import staged

__all__ = ["authority", "cascade", "compared", "control_subjects", "maps"]

PRED = (*UNIT, "pred")
#: Relative pronouns, floating quantifiers, their parts of speech and relations.
RELATIVE = ("che", "ch", "cui", "chi")
FLOATING = ("tutto", "quanto", "ambedue", "amendue", "entrambi", "ciascuno", "ognuno")
QUANTIFIER_POS, ADNOMINAL = ("adjective", "numeral", "pronoun"), ("amod", "nmod", "det", "det:poss", "nummod")


def facts(tokens: DataFrame) -> DataFrame:
    """Tokens with all that the steps ask for, kept in the shared folder."""
    t = with_facts(tokens)
    walks = guarded_walks(t)
    case = t.filter("deprel = 'case' AND head > 0").groupBy(*UNIT, F.col("head").alias("u")).agg(F.min_by(F.rtrim(F.lower("word"), F.lit("'")), "u").alias("marker"))
    host = t.select(*UNIT, F.col("u").alias("head"), F.col("deprel").alias("host_rel"), F.lower("pos").alias("host_pos"))
    joined = t.join(walks, [*UNIT, "u"]).join(case, [*UNIT, "u"], "left").join(host, [*UNIT, "head"], "left")
    oblique = lambda c: (c == "obl") | c.rlike("^obl:[a-zàèéìòù']+$")
    rel = F.col("deprel")
    hosts = (F.col("host_rel") == "advmod") | oblique(F.col("host_rel"))
    inside = ((rel == "nmod") | oblique(rel)) & (F.col("has_case") | ~F.col("marked")) | ((rel == "advmod") & F.lower("pos").contains("adverb"))
    cluster = F.when(hosts & F.col("host_pos").contains("adverb") & inside, F.col("head"))
    return staged(joined.withColumn("cluster", cluster), "cascade")


def control_subjects(tokens: DataFrame, frames: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``(unit keys, u, candidate, open)``: subjects that a predicate without one of its own can take.

    A walk up the heads, of eight steps at most, collects subjects, objects and obliques of each place,
    the nominal that a clause hangs on and the relative pronouns that stand for it, and a host with a fused
    pronoun. It ends at the first place with a subject; where that one is empty the controller is not known
    (``open``, one row without a candidate). ``frames`` have the roles of the derivation.
    """
    t = with_facts(tokens)
    subj = frames.filter("role = 'subj'").groupBy(*UNIT, F.col("pred").alias("u")).agg(F.bool_or(F.col("arg") == 0).alias("_void"), F.lit(True).alias("_settled"))
    start = t.select(*UNIT, "u", "head", "deprel").join(subj, [*UNIT, "u"], "left").na.fill(False, ["_void", "_settled"])
    start = start.withColumn("_asks", F.lit(True)) if asked is None else start.join(asked.select(*UNIT, "u", F.lit(True).alias("_asks")), [*UNIT, "u"], "left").na.fill(False, ["_asks"])
    steps = by_unit(start, UNIT, CLIMB, _climb).filter("size(places) > 0").select(*UNIT, "u", F.explode("places").alias("p"), "open")
    steps = staged(steps.select(*UNIT, "u", F.abs("p").alias("at"), (F.col("p") < 0).alias("adnominal"), "open"), "climbs")
    core = frames.filter("arg > 0 AND (role IN ('subj', 'obj', 'iobj') OR role LIKE 'obl%')").select(*UNIT, F.col("pred").alias("at"), F.col("arg").alias("candidate"))
    relative = F.rtrim(F.lower("word"), F.lit("'")).isin(*RELATIVE) & F.col("deprel").isin(*SUBJECTS) & (F.col("head_rel") == "acl:relcl") & (F.col("up") > 0)
    pronouns = t.filter(relative).select(*UNIT, F.col("up").alias("at"), F.col("u").alias("candidate"))
    fused = t.filter(F.regexp_replace("pos", r"\s", "").contains("+pronoun")).select(*UNIT, F.col("u").alias("at"), F.col("u").alias("candidate"))
    named = steps.filter("adnominal")
    found = (
        steps.join(core.union(fused), [*UNIT, "at"]).select(*UNIT, "u", "candidate")
        .union(named.select(*UNIT, "u", F.col("at").alias("candidate")))
        .union(named.join(pronouns, [*UNIT, "at"]).select(*UNIT, "u", "candidate"))
    ).distinct()
    unknown = steps.filter("open").select(*UNIT, "u").distinct()
    return found.withColumn("open", F.lit(False)).union(unknown.select(*UNIT, "u", F.lit(None).cast("int").alias("candidate"), F.lit(True).alias("open")))


#: What ``_climb`` finds: the places of each walk, negative where a clause hangs on one, and whether it ends open.
CLIMB = [T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("open", T.BooleanType())]


def _climb(columns: dict[str, pa.Array], base: np.ndarray, longest: int) -> dict[str, pa.Array]:
    """Walks up the heads, all tokens of a batch at once; a subject ends one after its place."""
    get = lambda name: columns[name].to_numpy(zero_copy_only=False)
    head = get("head").astype(np.int64)
    above = np.where(head > 0, base + head - 1, -1)
    hangs = pc.is_in(columns["deprel"], pa.array(["acl", "acl:relcl"])).to_numpy(zero_copy_only=False)
    void, settled = get("_void"), get("_settled")
    at, live, seen = np.arange(len(head)), get("_asks"), [np.arange(len(head))]
    ends, places = np.zeros(len(head), bool), []
    for _ in range(WALK):
        to = above[at]
        live = live & (to >= 0)
        for s in seen:
            live = live & (to != s)
        places.append(np.where(live, np.where(hangs[at], -1, 1) * (to - base + 1), 0))
        ends |= live & void[np.maximum(to, 0)]
        at = np.where(live, to, at)
        seen.append(at)
        live = live & ~settled[at]
    table = np.stack(places, axis=1)
    size = (table != 0).sum(axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(table[table != 0].astype(np.int32)))
    return {"places": lists, "open": pa.array(ends)}


def maps(frames: DataFrame) -> DataFrame:
    """``(unit keys, pred, arg, role, ord)``: the role of each argument of a predicate, itself left out.

    Rows stand by rank of the role, then argument; of several roles of one argument the last counts, and
    its place is that of the first.
    """
    rank = role_rank(F.col("role"))
    rows = frames.filter("role <> '' AND arg <> pred")
    return rows.groupBy(*PRED, "arg").agg(F.max_by(canonical_role(F.col("role")), F.struct(rank, "role")).alias("role"), F.min(rank).alias("first")).withColumn("ord", F.struct("first", "arg")).drop("first")


def _np_equal(pairs: DataFrame, t: DataFrame, spans: DataFrame) -> DataFrame:
    """The ``pairs(unit keys, …, a, b)`` that lie in one span whose head is one of them."""
    side = lambda n: t.select(*UNIT, F.col("u").alias(n), F.col("line").alias(f"{n}_line"), F.col("token").alias(f"{n}_at"))
    placed = pairs.filter("a <> b AND a > 0 AND b > 0").join(side("a"), [*UNIT, "a"]).join(side("b"), [*UNIT, "b"]).filter("a_line = b_line")
    s = spans.select("doc_id", F.col("line").alias("a_line"), F.col("start").alias("s0"), F.col("end").alias("s1"), F.col("head").alias("sh")).distinct()
    met = placed.join(s, ["doc_id", "a_line"]).filter("a_at BETWEEN s0 AND s1 AND b_at BETWEEN s0 AND s1 AND (sh = a_at OR sh = b_at)")
    return met.select(*pairs.columns).distinct()


def authority(given: DataFrame, derived: DataFrame, t: DataFrame, spans: DataFrame) -> DataFrame:
    """Maps of both sides, ``given`` true or false, without the subjects that are a matter of authority.

    ``derived`` has the roles of the derivation. By the derived subject of a predicate that both have:
    empty: the given one counts, both go. None: given ones go if control reaches them, or if an empty one.
    Inherited and at odds with its verb, or with the verb that it comes from: it goes, and the given ones as
    before. Inherited otherwise: both go where the head of the coordination, or a conjunct, has the given one.
    An empty given subject beside the derived one goes.
    """
    g, d = staged(maps(given), "given"), staged(maps(derived), "derived")
    known = given.select(*PRED).distinct().join(derived.select(*PRED).distinct(), list(PRED))
    first = lambda m, n: m.filter("role = 'subj'").groupBy(*PRED).agg(F.min("arg").alias(n), F.sort_array(F.collect_list("arg")).alias(f"{n}s"))
    token = t.select(*UNIT, F.col("u").alias("pred"), "deprel", "n_subj", "coord_any", F.when(F.col("person") != "", F.col("u")).when(F.col("finite_aux") > 0, F.col("finite_aux")).otherwise(F.col("u")).alias("finite"))
    p = known.join(first(g, "gs"), list(PRED), "left").join(first(d, "ds"), list(PRED), "left").join(token, list(PRED))
    p = p.withColumn("inherits", (F.col("deprel") == "conj") & (F.col("n_subj") == 0) & (F.col("ds") > 0))
    p = staged(p.withColumn("twice", F.coalesce((F.col("ds") > 0) & F.array_contains("gss", 0) & F.array_contains("gss", F.col("ds")), F.lit(False))), "subjects")
    # an inherited subject that does not agree
    asked = p.filter("inherits").select(*UNIT, F.col("ds").alias("subject"), F.col("finite").alias("head")).distinct()
    odd = agreement(t, asked).filter("verdict = 'disagree'").select(*UNIT, F.col("subject").alias("ds"), F.col("head").alias("finite"), F.lit(True).alias("odd")).distinct()
    marks = t.select(*UNIT, "u", F.when((F.col("person") != "") & (F.col("number") != "") & F.col("pos").contains("verb"), F.concat_ws(" ", "person", "number")).alias("form"))
    places = t.select(*UNIT, "u", F.when(F.col("person") != "", F.col("u")).when(F.col("finite_aux") > 0, F.col("finite_aux")).otherwise(F.col("u")).alias("f"))
    forms = places.join(marks.withColumnRenamed("u", "f"), [*UNIT, "f"]).select(*UNIT, "u", "form")
    donor = t.select(*UNIT, F.col("u").alias("ds"), F.col("head").alias("donor"))
    p = p.join(odd, [*UNIT, "ds", "finite"], "left").join(donor, [*UNIT, "ds"], "left")
    p = p.join(forms.select(*UNIT, F.col("u").alias("donor"), F.col("form").alias("their")), [*UNIT, "donor"], "left").join(forms.select(*UNIT, F.col("u").alias("pred"), F.col("form").alias("own")), list(PRED), "left")
    apart = F.coalesce((F.col("donor") > 0) & (F.col("donor") != F.col("pred")) & (F.col("their") != F.col("own")), F.lit(False))
    g_first = F.when(F.col("twice"), F.array_min(F.filter("gss", lambda x: x != 0))).otherwise(F.col("gs"))
    refused = F.col("inherits") & ~g_first.eqNullSafe(F.col("ds")) & (F.coalesce("odd", F.lit(False)) | apart)
    branch = F.when(F.col("ds") == 0, "void").when(F.col("ds").isNull(), "control").when(refused & (g_first == 0), "refused_void").when(refused, "refused").when(F.col("inherits") & (g_first != F.col("ds")), "shared")
    p = staged(p.select(*PRED, "gs", "gss", "ds", "twice", "coord_any", g_first.alias("g_first"), branch.alias("branch")), "branches")
    # control
    walked = p.filter("branch IN ('control', 'refused') AND gs IS NOT NULL")
    reach = control_subjects(t, derived, walked.select(*UNIT, F.col("pred").alias("u"))).withColumnRenamed("u", "pred")
    reach = staged(reach, "reach")
    cited = walked.select(*PRED, F.explode("gss").alias("arg"))
    heads = t.select(*UNIT, F.col("u").alias("arg"), F.col("coord_any").alias("arg_head"))
    cited = staged(cited.join(heads, [*UNIT, "arg"], "left"), "cited")
    named = reach.filter("NOT open").select(*PRED, "candidate")
    ok = cited.filter("arg = 0").select(*PRED, "arg")
    ok = ok.union(cited.join(reach.filter("open").select(*PRED), list(PRED), "left_semi").select(*PRED, "arg"))
    ok = ok.union(cited.join(named, list(PRED)).filter("candidate = arg OR candidate = arg_head").select(*PRED, "arg"))
    phrase = _np_equal(cited.join(named, list(PRED)).select(*PRED, F.col("arg").alias("a"), F.col("candidate").alias("b")), t, spans)
    ok = ok.union(phrase.select(*PRED, F.col("a").alias("arg")))
    # shared subjects
    shared = p.filter("branch = 'shared' AND g_first IS NOT NULL")
    # the first row of the head of the coordination, whatever it is compared with
    leads = given.filter("role = 'subj'").groupBy(*UNIT, F.col("pred").alias("coord_any")).agg(F.min("arg").alias("g_first"))
    ends = t.filter((F.col("head_rel") == "conj") & F.col("deprel").isin(*SUBJECTS)).select(*UNIT, F.col("up").alias("pred"), F.col("u").alias("g_first"))
    same = shared.join(leads, [*UNIT, "coord_any", "g_first"], "left_semi").select(*PRED, "g_first", "ds").union(shared.join(ends, [*PRED, "g_first"], "left_semi").select(*PRED, "g_first", "ds")).distinct()
    gone_g = ok.union(same.select(*PRED, F.col("g_first").alias("arg"))).union(p.filter("branch = 'void' AND gs IS NOT NULL").select(*PRED, F.col("gs").alias("arg")))
    gone_g = gone_g.union(p.filter("twice OR branch = 'refused_void'").select(*PRED, F.lit(0).alias("arg"))).distinct()
    gone_d = same.select(*PRED, F.col("ds").alias("arg")).union(p.filter("branch IN ('void', 'refused', 'refused_void')").select(*PRED, F.col("ds").alias("arg")))
    left_g = g.join(known, list(PRED), "left_semi").join(gone_g, [*PRED, "arg"], "left_anti").withColumn("given", F.lit(True))
    left_d = d.join(known, list(PRED), "left_semi").join(gone_d, [*PRED, "arg"], "left_anti").withColumn("given", F.lit(False))
    return left_g.select(*PRED, "arg", "role", "ord", "given").union(left_d.select(*PRED, "arg", "role", "ord", "given"))


def _renamed(rows: DataFrame, key: Column, role: Callable[[], Column]) -> DataFrame:
    """Rows under new argument names; rows that meet are one."""
    return rows.withColumn("key", key).groupBy(*PRED, "given", "key").agg(role().alias("role"), F.min("ord").alias("ord")).withColumnRenamed("key", "arg").select(*PRED, "arg", "role", "ord", "given")


def _least() -> Column:
    return F.min_by("role", F.struct(role_rank(F.col("role")), "role"))


def _matched(rows: DataFrame, equal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Given arguments take the name of the derived one of the same role that they are ``equal`` to.

    Only arguments that the other side does not name are matched: derived ones in order, each with the first
    given one that is left.
    """
    alone = rows.groupBy(*PRED, "arg").agg(F.bool_and("given").alias("only_g"), F.bool_and(~F.col("given")).alias("only_d"), F.min("role").alias("role")).filter("arg > 0 AND (only_g OR only_d)")
    pairs = alone.filter("only_g").select(*PRED, "role", F.col("arg").alias("a")).join(alone.filter("only_d").select(*PRED, "role", F.col("arg").alias("b")), [*PRED, "role"])
    listed = equal(pairs).groupBy(*PRED, "role").agg(F.sort_array(F.collect_list(F.struct("b", "a"))).alias("pairs"))

    def take(done: Column, x: Column) -> Column:
        free = ~F.exists(done, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]))
        return F.when(free, F.concat(done, F.array(x))).otherwise(done)

    chosen = F.aggregate("pairs", F.array().cast("array<struct<b:int,a:int>>"), take)
    new = listed.select(*PRED, F.inline(chosen)).select(*PRED, F.col("a").alias("arg"), F.col("b").alias("new"), F.lit(True).alias("given"))
    return rows.join(new, [*PRED, "arg", "given"], "left").withColumn("arg", F.coalesce("new", "arg")).select(*PRED, "arg", "role", "ord", "given")


STEPS = ("auxiliary", "stack", "cluster", "coordination", "phrase", "quantifier", "nominal")


def cascade(rows: DataFrame, t: DataFrame, spans: DataFrame, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """The maps of both sides after the steps, in the order in which ``steps`` names them."""
    arg = F.col("arg")
    places = t.select(*UNIT, F.col("u").alias("arg"), "deprel", "head", "aux_place", "nominal", "coord_head", "cluster", F.col("up").alias("cluster_up"), "marker")
    targets = {
        "auxiliary": F.when(F.col("given") & F.col("deprel").isin(*FUNCTION) & (F.col("aux_place") != F.col("pred")), F.col("aux_place")),
        "stack": F.when(F.col("given"), F.col("nominal")),
        "cluster": F.when(F.col("given") & ((F.col("role") == "obl") | F.col("role").startswith("obl:")) & (F.col("cluster") != F.col("pred")) & (F.col("cluster_up") == F.col("pred")), F.col("cluster")),
        "coordination": F.when(F.col("coord_head") != F.col("pred"), F.col("coord_head")),
    }
    before = rows.filter("NOT given").select(*PRED, F.col("arg").alias("head")).distinct()
    for step in steps:
        if step in targets:
            named = rows.join(places, [*UNIT, "arg"], "left")
            key = F.coalesce(targets[step], arg)
            if step == "stack":
                rows = _renamed(named, key, lambda: F.max_by("role", "ord"))
            elif step == "coordination":
                rows = _collapsed(named.withColumn("key", key), t)
            else:
                rows = _renamed(named, key, _least)
        elif step == "phrase":
            rows = _matched(rows, lambda pairs: _np_equal(pairs, t, spans))
        elif step == "quantifier":
            lemma, pos = F.lower("lemma"), F.lower(F.trim("pos"))
            floating = t.filter(lemma.isin(*FLOATING) & pos.isin(*QUANTIFIER_POS) & F.col("deprel").isin(*ADNOMINAL) & (F.col("head") > 0))
            above = t.select(*UNIT, F.col("u").alias("head"), F.col("coord_head").alias("top"))
            of = staged(floating.select(*UNIT, F.col("u").alias("a"), "head").join(above, [*UNIT, "head"]).select(*UNIT, "a", F.explode(F.array_distinct(F.array("head", "top"))).alias("b")), "floating")
            rows = _matched(rows, lambda pairs: pairs.join(of, [*UNIT, "a", "b"], "left_semi").select(*PRED, "role", "a", "b"))
        else:
            named_d = rows.filter("NOT given").select(*PRED, "arg", F.lit(True).alias("wanted"))
            loose = rows.join(places.select(*UNIT, "arg", "deprel", "head"), [*UNIT, "arg"], "left").join(named_d, [*PRED, "arg"], "left").join(before.withColumn("inside", F.lit(True)), [*PRED, "head"], "left")
            drop = F.col("given") & F.col("wanted").isNull() & F.col("role").rlike("^obl(:[a-zàèéìòù']+)?$") & (F.col("deprel") == "nmod") & F.col("inside")
            rows = loose.filter(~F.coalesce(drop, F.lit(False))).select(*PRED, "arg", "role", "ord", "given")
        rows = staged(rows, step)
    return rows


def _collapsed(named: DataFrame, t: DataFrame) -> DataFrame:
    """Conjuncts under the head of their coordination.

    The first citation sets whether the role is the head's own; a conjunct with a preposition of its own
    that differs from the head's competes only with others of the first one's kind. The least role wins.
    """
    head = t.select(*UNIT, F.col("u").alias("key"), F.col("marker").alias("head_marker"))
    rows = named.join(head, [*UNIT, "key"], "left").withColumn("own", F.col("key") == F.col("arg"))
    apart = ~F.col("own") & F.col("marker").isNotNull() & ~F.col("marker").eqNullSafe(F.col("head_marker"))
    rank = F.struct(role_rank(F.col("role")).alias("rank"), F.col("role"))
    item = F.struct("ord", "own", apart.alias("apart"), rank.alias("rank"))
    packed = rows.groupBy(*PRED, "given", "key").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min("ord").alias("ord"))
    first = F.col("items")[0]
    able = F.filter("items", lambda x: (x["ord"] == first["ord"]) | (x["own"] == first["own"]) | ~x["apart"])
    role = F.array_min(F.transform(able, lambda x: x["rank"]))["role"]
    return packed.select(*PRED, F.col("key").alias("arg"), role.alias("role"), "ord", "given")


def compared(rows: DataFrame) -> DataFrame:
    """``(unit keys, pred, arg, kind, role, given_role)``: where the two sides still differ."""
    g = F.col("given")
    pairs = rows.groupBy(*PRED, "arg").agg(F.max(F.when(g, F.col("role"))).alias("given_role"), F.max(F.when(~g, F.col("role"))).alias("role"))
    kind = F.when(F.col("given_role").isNull(), "missing_arg").when(F.col("role").isNull(), "extra_arg").when(F.col("role") != F.col("given_role"), "role_mismatch")
    return pairs.withColumn("kind", kind).filter("kind IS NOT NULL").select(*PRED, "arg", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("given_role", F.lit("")).alias("given_role"))
