"""Acceptance rules: differences between frames that are no faults.

A rule is a condition over one wide row: the difference, what is known of its argument (``a_``) and of
its predicate (``p_``). All rules are evaluated at once as columns, so switching one off, counting what
it accepts and counting what it alone accepts are filters and groupings, not runs over the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import canonical_case, parts, role_rank
from spanloom.operators.edges import UNIT, walks
from spanloom.operators.frames import with_children
from spanloom.sources.staging import staged

_X = "substr(given_role, 5)"
_NOMINAL = "((a_pos LIKE '%adjective%' OR a_pos LIKE '%noun%') AND a_pos NOT LIKE '%pronoun%')"
_OBLIQUE = "(given_role = 'obl' OR given_role LIKE 'obl:%')"
_VERB = "array_contains(split(a_pos, '[^a-z]+'), 'verb')"
_P_VERB = "array_contains(split(p_pos, '[^a-z]+'), 'verb')"
_IN_CASES = f"array_contains(a_cases, {_X})"
_IN_MARKS = f"(array_contains(a_cases, {_X}) OR array_contains(a_marks, {_X}))"
#: Subjects of the derived frame, and whether the argument is a clitic of a pronominal verb.
_SUBJECTS = "filter(map_keys(d), k -> d[k] = 'subj' AND k > 0)"
_CLITIC = "a_deprel IN ('obj', 'iobj', 'obl') AND hosted AND a_pos LIKE '%pronoun%' AND array_contains(a_slots, 'reflexive')"


def _supports(case: str, role: str) -> str:
    return (
        f"(CASE {role} WHEN 'subj' THEN {case} = 'nominative' WHEN 'obj' THEN {case} = 'accusative' WHEN 'iobj' THEN {case} = 'dative' "
        f"WHEN 'obl:a' THEN {case} IN ('dative', 'ablative', 'locative') ELSE {role} LIKE 'obl%' AND {case} IN ('ablative', 'locative') END)"
    )


def _slots_for(role: str) -> str:
    """Slots of a fused clitic that a role may fill."""
    return f"filter(a_slots, s -> {_supports('s', role)} OR (s = 'reflexive' AND {role} IN ('obj', 'iobj', 'obl:a')))"


_BARE = "a_pos = 'pronoun' AND size(a_slots) = 1"

#: Rule id to condition, in the order in which a difference is claimed.
CONDITIONS = {
    "CS": "kind = 'missing_tuple' AND derived_empty",
    "AV": "kind = 'missing_tuple' AND p_aux_given",
    "I": "kind = 'extra_tuple' AND p_aux_pred",
    "Y": f"kind = 'extra_tuple' AND ((p_deprel IN ('conj', 'appos', 'attr') AND NOT {_P_VERB}) OR p_n_cop > 0 OR p_aux_n_cop > 0)",
    "Z1": f"kind = 'extra_tuple' AND {_P_VERB} AND p_deprel IN ('nsubj', 'obj', 'iobj', 'obl', 'nmod', 'appos', 'attr', 'expl')",
    "AY": "kind = 'extra_tuple' AND p_deprel = 'amod' AND p_pos LIKE '%adjective%' AND p_n_complement > 0",
    "CH": f"kind = 'extra_tuple' AND p_deprel = 'conj' AND {_P_VERB} AND p_top_deprel IN ('amod', 'acl', 'acl:relcl') AND array_contains(split(p_top_pos, '[^a-z]+'), 'verb')",
    "CY": "kind = 'missing_arg' AND role IN ('ccomp', 'xcomp') AND arg_given",
    "Z2": f"kind = 'missing_arg' AND {_VERB} AND arg_given",
    "BM": "kind = 'missing_arg' AND role LIKE 'obl%' AND a_pos LIKE '%conjunction%'",
    "AW": f"kind = 'missing_arg' AND role IN ('obj', 'iobj', 'obl', 'obl:a') AND {_CLITIC}",
    "BX": "kind = 'missing_arg' AND role = 'obl' AND a_deprel = 'obl' AND a_pos LIKE '%adjective%' AND hosted AND a_n_case = 0",
    "DW": "kind = 'missing_arg' AND role = 'xcomp' AND a_deprel = 'attr' AND a_pos LIKE '%adjective%' AND hosted AND a_n_case = 0 AND exists(map_values(d), r -> r NOT IN ('subj', 'xcomp'))",
    "BA": f"kind = 'missing_arg' AND role = 'subj' AND arg > 0 AND size({_SUBJECTS}) >= 2 AND exists({_SUBJECTS}, k -> try_element_at(g, k) = 'subj')",
    "CW": f"kind = 'missing_arg' AND arg > 0 AND size({_SUBJECTS}) >= 2 AND arg > array_max({_SUBJECTS})",
    "DH": f"kind = 'missing_arg' AND arg > 0 AND size({_SUBJECTS}) >= 2 AND arg < array_max({_SUBJECTS}) AND try_element_at(g, array_max({_SUBJECTS})) = 'subj'",
    "DI": "kind = 'missing_arg' AND arg > 0 AND arg_given AND a_n_orphan > 0 AND a_head = pred",
    "AX1": "kind = 'missing_arg' AND array_contains(near, concat('control given ', role))",
    "BY": "kind = 'missing_arg' AND array_contains(near, concat('aux given ', role))",
    "L": "kind = 'role_mismatch' AND role = 'obl' AND given_role LIKE 'obl:%' AND a_n_case = 0",
    "M": "kind = 'role_mismatch' AND given_role = 'xcomp' AND role IN ('obj', 'subj')",
    "N": f"kind = 'role_mismatch' AND given_role LIKE 'obl:%' AND role IN ('obj', 'subj') AND {_IN_CASES}",
    "O": f"kind = 'role_mismatch' AND given_role LIKE 'obl:%' AND role LIKE 'obl:%' AND {_IN_CASES}",
    "P": "kind = 'role_mismatch' AND given_role IN ('ccomp', 'xcomp') AND role IN ('ccomp', 'xcomp')",
    "Q": f"kind = 'role_mismatch' AND given_role = 'ccomp' AND role IN ('obj', 'subj') AND {_VERB}",
    "U": f"kind = 'role_mismatch' AND {_BARE} AND {_supports('a_slots[0]', 'role')} AND NOT {_supports('a_slots[0]', 'given_role')}",
    "AL": f"kind = 'role_mismatch' AND a_pos LIKE '%pronoun%pronoun%' AND (array_sort(array(given_role, role)) = array('obj', 'obl:a') OR (size(a_slots) > 1 AND size({_slots_for('role')}) > 0 AND size({_slots_for('given_role')}) > 0 AND {_slots_for('role')} <> {_slots_for('given_role')}))",
    "AZ": f"kind = 'role_mismatch' AND given_role = 'xcomp' AND role = 'obl' AND a_deprel = 'obl' AND {_NOMINAL} AND hosted AND a_n_case = 0",
    "CQ": f"kind = 'role_mismatch' AND given_role LIKE 'obl:%' AND role = 'xcomp' AND hosted AND {_IN_MARKS}",
    "BD": f"kind = 'role_mismatch' AND {_CLITIC} AND given_role IN ('obj', 'iobj', 'obl', 'obl:a') AND role IN ('obj', 'iobj', 'obl', 'obl:a')",
    "DB": "kind = 'role_mismatch' AND p_lemma = 'essere' AND given_role = 'xcomp' AND role LIKE 'obl%' AND a_deprel = 'obl' AND hosted AND NOT exists(map_keys(d), k -> k <> arg AND d[k] = 'xcomp')",
    "J": f"kind = 'extra_arg' AND {_OBLIQUE} AND a_deprel = 'advmod' AND hosted AND (a_pos LIKE '%adverb%' OR a_pos LIKE '%noun%')",
    "R": f"kind = 'extra_arg' AND given_role = 'xcomp' AND a_deprel = 'advmod' AND hosted AND {_NOMINAL}",
    "S": f"kind = 'extra_arg' AND given_role LIKE 'obl:%' AND a_deprel = 'nmod' AND hosted AND {_IN_CASES}",
    "T": f"kind = 'extra_arg' AND given_role LIKE 'obl:%' AND a_deprel = 'advcl' AND hosted AND {_IN_MARKS}",
    "AA": "kind = 'extra_arg' AND given_role IN ('xcomp', 'ccomp') AND a_deprel IN ('acl', 'acl:relcl') AND (map_contains_key(d, a_head) OR map_contains_key(d, a_head_coord))",
    "AU": "kind = 'extra_arg' AND given_role = 'xcomp' AND a_deprel IN ('amod', 'advmod') AND a_pos LIKE '%adjective%' AND (map_contains_key(d, a_head) OR map_contains_key(d, a_head_coord))",
    "BH": "kind = 'extra_arg' AND given_role = 'subj' AND arg = 0 AND exists(map_keys(d), k -> d[k] = 'subj' AND try_element_at(g, k) = 'xcomp')",
    "BI": "kind = 'extra_arg' AND given_role = 'obj' AND a_deprel IN ('nsubj', 'nsubj:pass') AND a_head_deprel IN ('xcomp', 'ccomp') AND a_head_head = pred",
    "BF": f"kind = 'extra_arg' AND given_role = 'xcomp' AND a_deprel = 'cop' AND hosted AND {_NOMINAL} AND a_pos NOT LIKE '%verb%'",
    "AB": f"kind = 'extra_arg' AND a_deprel = 'expl' AND a_pos LIKE '%pronoun%' AND hosted AND (given_role IN ('obj', 'iobj', 'obl:a') OR (size(a_slots) > 1 AND exists(a_slots, s -> {_supports('s', 'given_role')})))",
    "AD": "kind = 'extra_arg' AND p_lemma = 'essere' AND given_role = 'xcomp' AND a_deprel = 'advmod' AND a_pos LIKE '%adverb%' AND hosted",
    "AE": "kind = 'extra_arg' AND a_pos LIKE '%pronoun%' AND a_deprel IN ('nsubj', 'nsubj:pass') AND a_head <> pred AND try_element_at(d, a_head) = given_role",
    "BT": "kind = 'extra_arg' AND p_deprel = 'acl:relcl' AND p_head = arg AND a_pos LIKE '%pronoun%' AND a_lemma IN ('chi', 'che', 'quale') AND a_n_det = 0",
    "CT": f"kind = 'extra_arg' AND given_role = 'xcomp' AND p_lemma = 'essere' AND p_deprel IN ('root', 'ccomp', 'xcomp', 'csubj', 'csubj:pass', 'advcl', 'acl', 'acl:relcl', 'parataxis') AND p_head = arg AND arg > 0 AND {_NOMINAL}",
    "BW": "kind = 'extra_arg' AND a_deprel = 'mark' AND hosted AND a_pos NOT LIKE '%conjunction%' AND (a_pos LIKE '%pronoun%' OR a_pos LIKE '%adjective%' OR a_pos LIKE '%adverb%')",
    "AX2": "kind = 'extra_arg' AND array_contains(near, concat('control derived ', given_role))",
    "CG": "kind = 'extra_arg' AND a_deprel IN ('amod', 'det', 'nummod') AND try_element_at(d, a_head) = given_role AND a_head_n_case >= 2",
    "CC": f"kind = 'extra_arg' AND a_deprel = 'conj' AND a_head = pred AND NOT {_VERB} AND a_pos NOT LIKE '%conjunction%' AND a_n_args = 0",
    "DA": "kind = 'extra_arg' AND given_role <> 'subj' AND derived_empty",
    "DD": f"kind = 'extra_arg' AND {_OBLIQUE} AND a_deprel = 'case' AND a_head = pred AND (a_pos LIKE '%adverb%' OR a_lemma IN ('dove', 'ove', 'onde'))",
    "EA": f"kind = 'extra_arg' AND given_role <> 'subj' AND p_deprel = 'parataxis' AND NOT {_P_VERB} AND size(d) = 1 AND try_element_at(d, 0) = 'subj'",
}


def context(found: DataFrame, frames: DataFrame, edges: DataFrame, cases: DataFrame) -> DataFrame:
    """The wide row of every difference: its argument (``a_``), its predicate (``p_``), the roles by
    argument of the derived and the given frame (``d``, ``g``), and which roles the argument has in
    frames of neighbouring predicates (``near``)."""
    tokens = with_children(edges)
    rel = F.col("deprel")
    lemmas = lambda label: F.collect_set(F.when(rel == label, F.col("lemma")))
    below = tokens.filter("head > 0").groupBy(*UNIT, F.col("head").alias("u")).agg(
        lemmas("case").alias("cases"),
        lemmas("mark").alias("marks"),
        F.count_if(rel == "case").alias("n_case"),
        F.count_if(rel == "cop").alias("n_cop"),
        F.count_if(rel.isin("det", "amod")).alias("n_det"),
        F.count_if(rel.isin("obl", "ccomp", "xcomp", "advcl")).alias("n_complement"),
        F.count_if(rel == "orphan").alias("n_orphan"),
    )
    on = [*UNIT, "u"]
    slots = cases.select(*on, parts(canonical_case(F.col("case"))).alias("slots"))
    ends = walks(tokens)
    none = F.array().cast("array<string>")
    wide = tokens.select(*on, "pos", "lemma", "deprel", "head", "n_args").join(ends, on).join(below, on, "left").join(slots, on, "left")
    wide = wide.na.fill(0, ["n_case", "n_cop", "n_det", "n_complement", "n_orphan"])
    wide = staged(wide.withColumns({c: F.coalesce(c, none) for c in ("cases", "marks", "slots")}), "wide")
    part = lambda prefix, key, columns: wide.select(*UNIT, F.col("u").alias(key), *(F.col(c).alias(f"{prefix}{c}") for c in columns))
    args = part("a_", "arg", ["deprel", "pos", "lemma", "cases", "marks", "n_case", "slots", "n_orphan", "n_det", "n_args", "head", "host"])
    heads = part("a_head_", "a_head", ["deprel", "head", "n_case", "coord_head"]).withColumnRenamed("a_head_coord_head", "a_head_coord")
    preds = part("p_", "pred", ["deprel", "pos", "lemma", "n_cop", "n_complement", "aux_head", "head", "top"])
    tops = part("p_top_", "p_top", ["deprel", "pos"])
    auxes = part("p_aux_", "p_aux_head", ["n_cop"])
    known = tokens.filter("pred").select(*UNIT, F.col("u").alias("p_aux_head"), F.lit(True).alias("aux_known"))
    given = F.col("given")
    best = lambda side: F.min_by(F.when(side, F.col("role")), F.when(side, F.struct(role_rank(F.col("role")), F.col("role"))))
    pairs = staged(frames.groupBy(*UNIT, "pred", "arg").agg(best(given).alias("g"), best(~given).alias("d")), "pairs")
    roles = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("arg", c))))
    maps = pairs.groupBy(*UNIT, "pred").agg(roles("d").alias("d"), roles("g").alias("g"))
    sides = frames.filter(~given).groupBy(*UNIT, "pred").agg(F.bool_and(F.col("role") == "").alias("derived_empty"))
    given_preds = frames.filter(given).select(*UNIT, "pred").distinct()
    named = given_preds.select(*UNIT, F.col("pred").alias("arg"), F.lit(True).alias("arg_given"))
    citing = wide.filter(rel.isin("aux", "aux:pass", "cop")).select(*UNIT, F.col("u").alias("pred"), "aux_head").join(given_preds, [*UNIT, "pred"])
    citing = citing.select(*UNIT, F.col("aux_head").alias("pred"), F.lit(True).alias("p_aux_given")).distinct()
    # frames of predicates at the other end of an xcomp edge, and of auxiliaries
    links = wide.filter("head > 0").select(*UNIT, "u", "head", "deprel")
    up = links.filter("deprel = 'xcomp'").select(*UNIT, F.col("u").alias("pred"), F.col("head").alias("other"), F.lit("control").alias("link"))
    down = links.filter(rel.isin("xcomp", "aux", "aux:pass", "cop")).select(*UNIT, F.col("head").alias("pred"), F.col("u").alias("other"), F.when(rel == "xcomp", "control").otherwise("aux").alias("link"))
    listed = pairs.select(*UNIT, F.col("pred").alias("other"), "arg", F.inline(F.filter(F.array(F.struct(F.lit("given").alias("side"), F.col("g").alias("role")), F.struct(F.lit("derived").alias("side"), F.col("d").alias("role"))), lambda x: x["role"].isNotNull())))
    near = up.union(down).filter("other <> pred").join(listed, [*UNIT, "other"]).groupBy(*UNIT, "pred", "arg").agg(F.collect_set(F.concat_ws(" ", "link", "side", "role")).alias("near"))

    rows = found.join(args, [*UNIT, "arg"], "left").join(heads, [*UNIT, "a_head"], "left").join(named, [*UNIT, "arg"], "left").join(preds, [*UNIT, "pred"])
    rows = rows.join(sides, [*UNIT, "pred"], "left").join(known, [*UNIT, "p_aux_head"], "left").join(auxes, [*UNIT, "p_aux_head"], "left").join(tops, [*UNIT, "p_top"], "left")
    rows = rows.join(maps, [*UNIT, "pred"], "left").join(citing, [*UNIT, "pred"], "left").join(near, [*UNIT, "pred", "arg"], "left")
    hosted = F.coalesce((F.col("a_head") == F.col("pred")) | (F.col("a_host") == F.col("pred")), F.lit(False))
    rows = rows.withColumn("hosted", hosted).withColumn("p_aux_pred", (F.col("p_aux_head") != F.col("pred")) & F.coalesce("aux_known", F.lit(False)))
    empty = F.create_map().cast("map<int,string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("a_cases", "a_marks", "a_slots", "near")}).withColumns({c: F.coalesce(c, empty) for c in ("d", "g")})
    return rows.na.fill("", ["a_deprel", "a_pos", "a_lemma", "a_head_deprel"]).na.fill(0, ["a_n_case", "a_n_orphan", "a_n_det", "a_n_args", "a_head", "a_head_head", "a_head_n_case", "a_head_coord"]).na.fill(False, ["derived_empty", "arg_given", "p_aux_given"])


def with_hits(rows: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``hits``: ids of the enabled rules that accept the difference, in order."""
    flags = [F.when(F.expr(c), r) for r, c in CONDITIONS.items() if r not in disabled]
    return rows.withColumn("hits", F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>"))


def judged(rows: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rule_id``: the first rule that accepts the difference; empty if none does."""
    return with_hits(rows, disabled).withColumn("rule_id", F.coalesce(F.try_element_at("hits", F.lit(1)), F.lit(""))).drop("hits")


def census(rows: DataFrame) -> DataFrame:
    """``(rule_id, hits, sole)`` of every rule, also of those that accept nothing."""
    each = with_hits(rows).select(F.explode("hits").alias("rule_id"), (F.size("hits") == 1).alias("sole"))
    catalogue = F.explode(F.array(*map(F.lit, CONDITIONS)))
    none = rows.sparkSession.range(1).select(catalogue.alias("rule_id"), F.lit(None).cast("boolean").alias("sole"))
    return each.union(none).groupBy("rule_id").agg(F.count("sole").alias("hits"), F.count_if("sole").alias("sole"))


def ablation(rows: DataFrame) -> DataFrame:
    """``(disabled, kind, n)``: open differences with all rules ('') and with each one off, in one pass.

    A difference is open without a rule if that rule alone accepts it; open ones stay open.
    """
    first = F.coalesce(F.try_element_at("hits", F.lit(1)), F.lit(""))
    tally = with_hits(rows).filter(F.size("hits") < 2).groupBy("kind", first.alias("sole")).agg(F.count("*").alias("n"))
    off = F.when(F.col("sole") == "", F.array(*map(F.lit, ["", *CONDITIONS]))).otherwise(F.array("sole"))
    return tally.select(F.explode(off).alias("disabled"), "kind", "n").groupBy("disabled", "kind").agg(F.sum("n").alias("n"))
