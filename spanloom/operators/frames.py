"""Predicate–argument frames: derivation from edges, diff against given ones, repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import canonical_role, role_rank
from spanloom.operators import derivation
from spanloom.operators.derivation import CLAUSES, ROLES
from spanloom.operators.edges import UNIT

__all__ = ["CLAUSES", "ROLES"]


def with_children(edges: DataFrame, together: bool = False) -> DataFrame:
    """Edges with what their children tell and whether a token is a predicate (``derivation.with_facts``)."""
    return derivation.with_facts(edges, together=together)


def predicates(edges: DataFrame) -> DataFrame:
    """Heads of clauses, conjuncts that hang on them, verbs with an argument of their own."""
    return with_children(edges).filter("pred").select(*UNIT, "u")


def arguments(edges: DataFrame) -> DataFrame:
    """``(unit keys, pred, role, arg)``: children of predicates that are arguments, with canonical roles."""
    own = with_children(edges).filter(F.col("deprel").isin(*ROLES) & F.col("head_pred"))
    return own.select(*UNIT, F.col("head").alias("pred"), canonical_role(derivation.role_of()).alias("role"), F.col("u").alias("arg"))


def derived(edges: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """All frames (``derivation.frames``) with canonical roles."""
    return derivation.frames(edges, cases).withColumn("role", canonical_role(F.col("role")))


def sided(given: DataFrame, wanted: DataFrame) -> DataFrame:
    """Both sets of frames in one, told apart by ``given``."""
    cols = [*UNIT, "pred", "role", "arg"]
    return given.select(*cols, F.lit(True).alias("given")).union(wanted.select(*cols, F.lit(False).alias("given")))


def divergence(frames: DataFrame) -> DataFrame:
    """``(unit keys, pred, arg, kind, role, given_role)``: what differs between the two sides.

    One grouping by argument and a window over predicates; a predicate on one side only is one row. Rows are
    dealt by predicate once, which does for both.
    """
    rank = F.struct(role_rank(F.col("role")), F.col("role"))
    best = lambda side: F.min_by(F.when(side, F.col("role")), F.when(side, rank))
    g = F.col("given")
    pairs = frames.repartition(*UNIT, "pred").groupBy(*UNIT, "pred", "arg").agg(best(g).alias("given_role"), best(~g).alias("wanted"))
    by = Window.partitionBy(*UNIT, "pred")
    sides = pairs.withColumn("in_g", F.count("given_role").over(by) > 0).withColumn("in_d", F.count("wanted").over(by) > 0)
    sides = sides.withColumn("first", F.row_number().over(by.orderBy("arg")) == 1)
    met = F.col("in_g") & F.col("in_d")
    kind = (
        F.when(~met & F.col("in_g"), "extra_tuple")
        .when(~met, "missing_tuple")
        .when(F.col("given_role").isNull(), "missing_arg")
        .when(F.col("wanted").isNull(), "extra_arg")
        .when(F.col("wanted") != F.col("given_role"), "role_mismatch")
    )
    rows = sides.withColumn("kind", kind).filter(F.col("kind").isNotNull() & (met | F.col("first")))
    shown = lambda c: F.when(met, F.coalesce(c, F.lit(""))).otherwise("")
    return rows.select(*UNIT, "pred", F.when(met, F.col("arg")).otherwise(0).alias("arg"), "kind", shown("wanted").alias("role"), shown("given_role").alias("given_role"))


def dual_roles(frames: DataFrame) -> DataFrame:
    """Arguments that one predicate holds in several roles."""
    return frames.filter("arg > 0").groupBy(*UNIT, "pred", "arg").agg(F.countDistinct("role").alias("n_roles")).filter("n_roles > 1")


def tuples(frames: DataFrame) -> DataFrame:
    """``(unit keys, pred, args)`` with arguments as text in canonical order; empty rows add none."""
    item = F.struct(role_rank(F.col("role")).alias("rank"), F.col("arg"), F.col("role"))
    listed = F.sort_array(F.collect_list(F.when(F.col("role") != "", item)))
    shown = F.array_join(F.transform(listed, lambda x: F.concat(x["role"], F.lit("="), x["arg"].cast("string"))), " ")
    return frames.groupBy(*UNIT, "pred").agg(shown.alias("args"))


def null_subject_repairs(violations: DataFrame) -> DataFrame:
    """Predicates whose empty subject stands for exactly one missing one: ``(unit keys, pred, arg)``."""
    rows = violations.withColumn("miss", F.when((F.col("kind") == "missing_arg") & (F.col("role") == "subj") & (F.col("arg") > 0), F.col("arg")))
    void = (F.col("kind") == "extra_arg") & (F.col("given_role") == "subj") & (F.col("arg") == 0)
    found = rows.groupBy(*UNIT, "pred").agg(F.count("miss").alias("n"), F.min("miss").alias("arg"), F.count_if(void).alias("voids"))
    return found.filter("n = 1 and voids = 1").select(*UNIT, "pred", "arg")


def repairs(violations: DataFrame, verdicts: DataFrame, stacks: DataFrame) -> DataFrame:
    """Rewrites of given rows that the tree makes certain: ``(unit keys, pred, kind, arg, role)``.

    null_subject: an empty subject becomes the one missing subject, if ``verdicts`` say that it agrees;
    role_label: a bare oblique takes its preposition; prep_stack: an oblique takes the other preposition of
    one stack (``stacks``: the forms below each token).
    """
    agreed = verdicts.filter("verdict = 'agree'").select(*UNIT, F.col("head").alias("pred"), F.col("subject").alias("arg"))
    empty = null_subject_repairs(violations).join(agreed, [*UNIT, "pred", "arg"]).select(*UNIT, "pred", F.lit("null_subject").alias("kind"), "arg", F.lit("subj").alias("role"))
    below = stacks.select(*UNIT, F.col("u").alias("arg"), F.split("lemmas", r"\+").alias("stack"))
    labels = violations.filter("kind = 'role_mismatch' and role like 'obl:%'").join(below, [*UNIT, "arg"], "left")
    named = lambda c: F.array_contains(F.coalesce("stack", F.array().cast("array<string>")), F.substring(F.col(c), F.lit(5), F.length(c)))
    kind = F.when(F.col("given_role") == "obl", "role_label").when(F.col("given_role").startswith("obl:") & named("role") & named("given_role"), "prep_stack")
    return empty.union(labels.select(*UNIT, "pred", kind.alias("kind"), "arg", "role").filter("kind is not null"))


def supports(case: Column, role: Column) -> Column:
    """Whether a case can carry a role; a joined case and an unknown role support nothing."""
    return (
        F.when(role == "subj", case == "nominative")
        .when(role == "obj", case == "accusative")
        .when(role == "iobj", case == "dative")
        .when(role == "obl:a", case.isin("dative", "ablative", "locative"))
        .when((role == "obl") | role.startswith("obl:"), case.isin("ablative", "locative"))
        .otherwise(F.lit(False))
    )
