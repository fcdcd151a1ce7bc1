"""Predicate–argument frames from edges and features, in the order in which their parts depend on each other.

1. Predicates: heads of clauses; conjuncts whose chain hangs on one; verbs with an argument of their own;
   finite conjuncts whose chain meets one of these.
2. Arguments: own children, and those stranded on a copula or auxiliary.
3. Subjects that a conjunct takes from its chain; an empty one for other finite predicates.
4. Remnants of a gapped conjunct fill the slots of its head a second time, in a queue.

What children tell is read from the arrays of a batch of units. Chains are followed by doubling over them, so a unit
of n tokens takes log2 n steps and no join. Each of the named rules can be off (``on``), also by a
column, so that several variants run in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import canonical_case, first_lemma, is_verb, normal_preposition, role_rank
from spanloom.operators.edges import FUNCTION, UNIT, by_unit
from spanloom.sources.staging import staged

#: Relations of clause heads, subjects, and roles of argument relations.
CLAUSES = ("root", "ccomp", "xcomp", "csubj", "csubj:pass", "advcl", "acl", "acl:relcl", "parataxis")
SUBJECTS = ("nsubj", "nsubj:pass", "csubj", "csubj:pass")
ROLES = {**dict.fromkeys(SUBJECTS, "subj"), "obj": "obj", "iobj": "iobj", "attr": "attr", "xcomp": "xcomp", "ccomp": "ccomp", "obl": "obl", "obl:agent": "obl"}
#: Rules of the derivation that can be off.
RULES = ("AM", "AN", "AT", "BN", "BZ", "CA", "CN", "CZ", "DU", "EF")
_BIT = {name: 1 << i for i, name in enumerate(ROLES)}
_SUBJECT_BITS = sum(_BIT[s] for s in SUBJECTS)
_ALL_BITS = (1 << len(_BIT)) - 1
_FAR, _NONE = 2147483647, 2**62

On = Callable[[str], Column]


def always(_: str) -> Column:
    return F.lit(True)


def _bits(rel: Column) -> Column:
    out = F.lit(0)
    for name, bit in _BIT.items():
        out = F.when(rel == name, bit).otherwise(out)
    return out


def _children(tokens: DataFrame, keys: tuple[str, ...], together: bool = False) -> DataFrame:
    """Tokens with what their children and, through function words, grandchildren tell."""
    own = tokens.schema["u"].dataType
    new = [
        *(T.StructField(n, T.LongType()) for n in ("n_args", "n_subj")),
        *(T.StructField(n, own) for n in ("first_subj", "finite_aux", "conj_subj")),
        *(T.StructField(n, T.IntegerType()) for n in ("arg_bits", "aux_bits")),
        *(T.StructField(n, T.BooleanType()) for n in ("marked", "has_aux", "aux_person", "gapped", "has_case")),
        *(T.StructField(n, T.StringType()) for n in ("prep", "case_lemma")),
    ]
    return by_unit(tokens, keys, new, told, together)


#: Relations that parents ask for, beside arguments.
_ASKED = {"case": 1 << 16, "mark": 1 << 17, "orphan": 1 << 18, "conj": 1 << 19, **dict.fromkeys(FUNCTION, 1 << 20)}


def told(columns: dict[str, pa.Array], base: np.ndarray, longest: int) -> dict[str, pa.Array]:
    """What the children of each token tell, for all units of a batch at once."""
    size, u = len(base), columns["u"].to_numpy().astype(np.int64)
    rel = pc.fill_null(columns["deprel"], "").dictionary_encode()
    bits = np.array([_BIT.get(x, 0) | _ASKED.get(x, 0) for x in rel.dictionary.to_pylist()], np.int64)[rel.indices.to_numpy()]
    head = pc.fill_null(columns["head"], 0).to_numpy().astype(np.int64)
    end = np.append(np.flatnonzero(base == np.arange(size))[1:], size)  # of each unit
    lengths = np.diff(np.append(0, end))
    child = np.flatnonzero((head > 0) & (head <= np.repeat(lengths, lengths)))
    parent, kind = (base + head - 1)[child], bits[child]
    argument, subject, case, aux = (kind & _ALL_BITS) > 0, (kind & _SUBJECT_BITS) > 0, (kind & _ASKED["case"]) > 0, (kind & _ASKED["aux"]) > 0
    finite = aux & pc.fill_null(pc.not_equal(columns["person"], ""), False).to_numpy(zero_copy_only=False)[child]

    def count(among: np.ndarray) -> np.ndarray:
        return np.bincount(parent[among], minlength=size)

    def least(among: np.ndarray, at: np.ndarray, of: np.ndarray, none: int) -> np.ndarray:
        out = np.full(size, _NONE)
        np.minimum.at(out, at[among], of[among])
        return np.where(out == _NONE, none, out)

    def first_lemma_of(order: list[np.ndarray]) -> pa.Array:
        """The lemma of the preposition that comes first."""
        mine = np.flatnonzero(case)
        mine = mine[np.lexsort([*(o[child[mine]] for o in order), parent[mine]])]
        at, first = np.unique(parent[mine], return_index=True)
        found = np.full(size, -1)
        found[at] = child[mine[first]]
        return columns["lemma"].take(pa.array(np.maximum(found, 0), mask=found < 0))

    arg_bits, aux_bits = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.bitwise_or.at(arg_bits, parent[argument], kind[argument] & _ALL_BITS)
    n_subj = count(subject)
    far = ((kind & _ASKED["conj"]) > 0) & (n_subj[child] > 0)
    np.bitwise_or.at(aux_bits, parent[aux], arg_bits[child[aux]])
    place = [u, columns["token"].to_numpy().astype(np.int64)] if "token" in columns else [u]
    kin = columns["u"].type
    return {
        "n_args": pa.array(count(argument)),
        "n_subj": pa.array(n_subj),
        "first_subj": pa.array(least(subject, parent, u[child], 0), kin),
        "finite_aux": pa.array(least(finite, parent, u[child], 0), kin),
        "conj_subj": pa.array(least(far, parent, u[child], _FAR), kin),
        "arg_bits": pa.array(arg_bits, pa.int32()),
        "aux_bits": pa.array(aux_bits, pa.int32()),
        "marked": pa.array(count((kind & _ASKED["mark"]) > 0) > 0),
        "has_aux": pa.array(count(aux) > 0),
        "aux_person": pa.array(count(finite) > 0),
        "gapped": pa.array(count((kind & _ASKED["orphan"]) > 0) > 0),
        "has_case": pa.array(count(case) > 0),
        "prep": first_lemma_of([u]),
        "case_lemma": first_lemma_of(place),
    }


def with_facts(tokens: DataFrame, keys: tuple[str, ...] = UNIT, on: On = always, together: bool = False) -> DataFrame:
    """Tokens with ``pred`` (whether one is a predicate), ``inherited`` (the subject that it takes from its
    chain, else 0), what children tell, and of its head and its head's head what arguments ask for.

    Needs keys, u (1, 2, … in a unit), head, deprel, pos, lemma, person. Tokens that have these columns
    already are returned as they are. ``together``: see ``edges.by_unit``.
    """
    if "inherited" in tokens.columns:
        return tokens
    if "aux_bits" not in tokens.columns:
        if not together:
            tokens, together = tokens.repartition(*keys).sortWithinPartitions(*keys, "u"), True
        tokens = _children(tokens, keys, together)
    rel, verb = F.col("deprel"), is_verb(F.col("pos"))
    bare, word = F.col("n_args") == 0, F.lower("pos").contains("conjunction")
    clause = rel.isin(*CLAUSES) & ~(word & bare & on("BN")) & ~(F.col("gapped") & ~verb & on("AN"))
    member = (rel == "conj") & ~word & ~F.col("gapped")
    t = tokens.withColumns({
        "_clause": rel.isin(*CLAUSES),
        "_sure": clause | (verb & ~rel.isin(*FUNCTION) & ~bare),
        "_first": member & ~(~verb & bare & ~F.col("has_aux") & on("CA")),
        "_second": member & verb & (F.col("person") != "") & on("BZ"),
        "_asks": (rel == "conj") & (F.col("n_subj") == 0) & (verb | ~on("AT")) & ~F.col("marked"),
        "_stop": (F.col("first_subj") > 0) | (rel != "conj") | (F.col("marked") & on("DU")),
        "_conj": rel == "conj",
        "_near": F.when(on("EF"), F.col("conj_subj")).otherwise(_FAR),
    })
    return by_unit(t, keys, SEEN, chained, together)


#: What ``chained`` finds for each token.
SEEN = [
    *(T.StructField(n, T.BooleanType()) for n in ("pred", "head_pred", "head_gapped", "head_case", "up_pred")),
    *(T.StructField(n, T.IntegerType()) for n in ("inherited", "up", "up_bits")),
    T.StructField("head_rel", T.StringType()),
]


def chained(columns: dict[str, pa.Array], base: np.ndarray, longest: int) -> dict[str, pa.Array]:
    """Chains of conjuncts by doubling, for all units of a batch at once, and what heads tell.

    ``base`` is where a token's unit begins. ``one`` and ``two`` say whether the chain above a token meets
    a clause, or a clause or sure predicate; ``to`` where the search for a subject that starts here ends,
    and ``near`` the least conjunct with a subject of its own that hangs on a place on the way.
    """
    get = lambda name: columns[name].to_numpy(zero_copy_only=False)
    u, head, first = get("u").astype(np.int64), get("head").astype(np.int64), get("first_subj").astype(np.int64)
    here = np.arange(len(u))
    above = np.where(head > 0, base + head - 1, -1)
    h = np.maximum(above, 0)
    clause, sure, stops, near = get("_clause"), get("_sure"), get("_stop"), get("_near").astype(np.int64)
    up = np.where(get("_conj"), above, -1)
    one, two = (up >= 0) & clause[h], (up >= 0) & (clause | sure)[h]
    to = np.where(stops, here, above)
    for _ in range(longest.bit_length() + 1):
        j, t = np.maximum(up, 0), np.maximum(to, 0)
        one, two = one | ((up >= 0) & one[j]), two | ((up >= 0) & two[j])
        near = np.where(to >= 0, np.minimum(near, near[t]), near)
        up, to = np.where(up >= 0, up[j], -1), np.where(to >= 0, to[t], -1)
    pred = sure | (get("_first") & one) | (get("_second") & two)
    end = np.where(above >= 0, to[h], -1)
    source = np.maximum(end, 0)
    takes = pred & get("_asks") & (end >= 0) & stops[source] & (near[h] >= u)
    g = np.maximum(above[h], 0)
    further = (above >= 0) & (above[h] >= 0)
    return {
        "pred": pa.array(pred),
        "inherited": pa.array(np.where(takes, first[source], 0), pa.int32()),
        "head_pred": pa.array((above >= 0) & pred[h]),
        "head_rel": pc.if_else(pa.array(above >= 0), columns["deprel"].take(pa.array(h)), ""),
        "head_gapped": pa.array((above >= 0) & get("gapped")[h]),
        "head_case": pa.array((above >= 0) & get("has_case")[h]),
        "up": pa.array(np.where(further, head[h], 0), pa.int32()),
        "up_pred": pa.array(further & pred[g]),
        "up_bits": pa.array(np.where(further, get("arg_bits")[g], 0), pa.int32()),
    }


def role_of() -> Column:
    """The role of an argument; an oblique takes its first preposition."""
    plain = F.element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), F.col("deprel"))
    lemma = first_lemma(F.coalesce("case_lemma", F.lit("")))
    return F.when((plain == "obl") & (lemma != ""), F.concat(F.lit("obl:"), normal_preposition(lemma))).otherwise(plain)


def _slots(rows: DataFrame, keys: tuple[str, ...], on: On) -> DataFrame:
    """``(keys, pred, slot, place)``: the roles of a predicate in the order in which remnants take them.

    Roles stand by rank, then by their first argument; one that only an empty argument fills comes last.
    """
    first = rows.filter("role <> ''").groupBy(*keys, "pred", F.col("role").alias("slot")).agg(F.min("arg").alias("first"))
    empty = F.when(on("CN"), F.col("first") == 0).otherwise(F.col("first") > 0)
    order = Window.partitionBy(*keys, "pred").orderBy(empty, role_rank(F.col("slot")), "first", "slot")
    return first.withColumn("place", F.row_number().over(order))


def remnants(t: DataFrame, rows: DataFrame, cases: DataFrame | None, keys: tuple[str, ...] = UNIT, on: On = always) -> DataFrame:
    """``(keys, pred, role, arg)``: the slots that the remnants of gapped conjuncts fill.

    The remnants of a conjunct are itself and its orphans, in order. One with a preposition takes the
    oblique slot of that name; one whose case names a core slot takes that; the rest take what is left,
    both in order.
    """
    conj = (F.col("deprel") == "conj") & F.col("gapped") & F.col("head_pred")
    orphan = (F.col("deprel") == "orphan") & (F.col("head_rel") == "conj") & F.col("up_pred")
    label = F.when(F.col("has_case"), F.when(first_lemma(F.coalesce("case_lemma", F.lit(""))) != "", F.concat(F.lit("obl:"), normal_preposition(first_lemma(F.coalesce("case_lemma", F.lit("")))))).otherwise("obl"))
    left = t.filter(conj | orphan).select(
        *keys, F.when(conj, F.col("head")).otherwise(F.col("up")).alias("pred"), F.when(conj, F.col("u")).otherwise(F.col("head")).alias("conjunct"),
        (~conj).alias("later"), F.col("u").alias("arg"), label.alias("label"), F.when(conj, F.col("has_case")).otherwise(F.col("head_case")).alias("shared"),
    )
    if cases is not None:
        value = canonical_case(F.col("case"))
        core = F.when(value == "nominative", "subj").when(value == "accusative", "obj").when(value == "dative", "iobj")
        named = cases.select(*(c for c in keys if c in cases.columns), F.col("u").alias("arg"), core.alias("core")).filter("core IS NOT NULL")
        left = left.join(named, [*(c for c in keys if c in cases.columns), "arg"], "left").withColumn("core", F.when(on("CZ"), F.col("core")))
    else:
        left = left.withColumn("core", F.lit(None).cast("string"))
    group = (*keys, "pred", "conjunct")
    open_slots = left.select(*group, "shared").distinct().join(_slots(rows, keys, on), [*keys, "pred"]).filter(~(F.col("shared") & (F.col("slot") == "subj")))
    named = open_slots.select(*group, "slot", "place")
    order = Window.partitionBy(*group).orderBy("later", "arg")
    queue = left.withColumn("nth", F.row_number().over(order))

    def claimed(queue: DataFrame, by: str) -> DataFrame:
        """``by`` is the slot that a remnant names; the first to name an open one has it."""
        free = named.select(*group, F.col("slot").alias(by), F.lit(True).alias("_open"))
        met = queue.join(free, [*group, by], "left")
        asks = F.col("_open") & F.col("taken").isNull()
        rank = F.row_number().over(Window.partitionBy(*group, by, asks).orderBy("nth"))
        return met.withColumn("taken", F.when(F.col("taken").isNotNull(), F.col("taken")).when(asks & (rank == 1), F.col(by))).drop("_open")

    queue = claimed(claimed(queue.withColumn("taken", F.lit(None).cast("string")), "label"), "core")
    sure = queue.filter("taken IS NOT NULL").select(*group, F.col("taken").alias("slot"), "arg")
    rest = queue.filter("taken IS NULL").withColumn("k", F.row_number().over(order)).select(*group, "arg", "k")
    free = named.join(sure.select(*group, "slot"), [*group, "slot"], "left_anti")
    free = free.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy("place"))).select(*group, "slot", "k")
    paired = rest.join(free, [*group, "k"]).select(*group, "slot", "arg")
    return sure.union(paired).select(*keys, "pred", F.col("slot").alias("role"), "arg")


def frames(tokens: DataFrame, cases: DataFrame | None = None, keys: tuple[str, ...] = UNIT, on: On = always) -> DataFrame:
    """``(keys, pred, role, arg)``: all frames. An empty subject is argument 0; a predicate with nothing at
    all has one row without a role. ``cases`` (keys, u, case) is read for remnants only."""
    t = with_facts(tokens, keys, on)
    rel, u = F.col("deprel"), F.col("u")
    row = lambda when, pred, role, arg: F.when(when, F.struct(pred.alias("pred"), role.alias("role"), arg.cast("int").alias("arg")))
    stranded = on("AM") & rel.isin(*(r for r in ROLES if r not in SUBJECTS)) & F.col("head_rel").isin(*FUNCTION) & F.col("up_pred") & (_bits(rel).bitwiseAND(F.col("up_bits")) == 0)
    more = on("AM") & (F.col("aux_bits").bitwiseAND(F.lit((1 << len(_BIT)) - 1 - _SUBJECT_BITS)).bitwiseAND(F.bitwise_not("arg_bits")) > 0)
    finite = (F.col("person") != "") | F.col("aux_person")
    own = F.col("pred") & (F.col("n_subj") == 0)
    each = F.array(
        row(rel.isin(*ROLES) & F.col("head_pred"), F.col("head"), role_of(), u),
        row(stranded, F.col("up"), role_of(), u),
        row(own & (F.col("inherited") > 0), u, F.lit("subj"), F.col("inherited")),
        row(own & (F.col("inherited") == 0) & finite, u, F.lit("subj"), F.lit(0)),
        row(own & (F.col("inherited") == 0) & ~finite & (F.col("n_args") == 0) & ~more, u, F.lit(""), F.lit(0)),
    )
    rows = t.select(*keys, F.inline(F.filter(each, lambda x: x.isNotNull())))
    gapped = t.filter(F.col("gapped") & (rel == "conj") & F.col("head_pred")).select(*keys, F.col("head").alias("pred")).distinct()
    return rows.union(remnants(t, rows.join(gapped, [*keys, "pred"], "left_semi"), cases, keys, on))


def census(tokens: DataFrame, cases: DataFrame | None = None, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """``(rule, n_more, n_fewer)``: how many rows of frames appear, and go, if a rule is off.

    All variants are derived in one pass, keyed by the rule that is off; without a rule is the base.
    """
    told = staged(_children(tokens, keys).drop("lemma", "token", "prep"), "children")  # the same for all variants
    variants = told.withColumn("off", F.explode(F.array(F.lit(""), *map(F.lit, RULES))))
    rows = frames(variants, cases, (*keys, "off"), lambda r: F.col("off") != r)
    sides = rows.groupBy(*keys, "pred", "role", "arg").agg(F.collect_set("off").alias("there"))
    each = sides.select(F.array_contains("there", "").alias("base"), "there", F.explode(F.array(*map(F.lit, RULES))).alias("rule"))
    without = F.array_contains("there", F.col("rule"))
    return each.groupBy("rule").agg(F.count_if(without & ~F.col("base")).alias("n_more"), F.count_if(~without & F.col("base")).alias("n_fewer"))
