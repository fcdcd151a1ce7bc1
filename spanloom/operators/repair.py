"""Rewrites of given frames to a fixpoint: one at a time in each unit, kept only if the unit improves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.edges import UNIT
from spanloom.operators.validate import improved
from spanloom.sources.staging import dropped, staged

ROW = ("pred", "role", "arg")


def rewritten(given: DataFrame, rewrites: DataFrame) -> DataFrame:
    """``given`` with the row of each of ``rewrites(unit keys, pred, old_role, old_arg, role, arg)`` replaced."""
    old = rewrites.select(*UNIT, "pred", F.col("old_role").alias("role"), F.col("old_arg").alias("arg"), F.col("role").alias("new_role"), F.col("arg").alias("new_arg"))
    joined = given.join(old, [*UNIT, *ROW], "left")
    return joined.select(*UNIT, "pred", F.coalesce("new_role", "role").alias("role"), F.coalesce("new_arg", "arg").cast("int").alias("arg"))


def fixpoint(given: DataFrame, wanted: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame], rewrites: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(unit keys, pred, kind, role, arg, kept, round)``: every rewrite tried, in the order of the rounds.

    ``judge(given, wanted)`` tells the differences with a ``class``, ``rewrites`` what could be rewritten for
    these: ``(unit keys, pred, kind, arg, role)``. In a round each open unit tries its first rewrite that
    was not tried before; it stays if the unit has fewer differences and none of a new class. Units without
    one are closed and not looked at again, so the rounds end; each is written to the shared folder.
    """
    tried = None
    rows, targets, turn = staged(given.select(*UNIT, *ROW), "round"), staged(wanted.select(*UNIT, *ROW), "targets"), 0
    while True:
        turn += 1
        before = staged(judge(rows, targets), "differences")
        found = rewrites(before)
        # a null subject is the row (subj, 0); a label is the row with the old role at that argument
        named = before.filter("kind = 'role_mismatch'").select(*UNIT, "pred", "arg", "given_role")
        found = found.join(named, [*UNIT, "pred", "arg"], "left")
        empty = F.col("kind") == "null_subject"
        found = found.select(*UNIT, "pred", "kind", "role", "arg", F.when(empty, "subj").otherwise(F.col("given_role")).alias("old_role"), F.when(empty, 0).otherwise(F.col("arg")).alias("old_arg"))
        if tried is not None:
            found = found.join(tried.select(*UNIT, "pred", "kind", "old_role", "old_arg"), [*UNIT, "pred", "kind", "old_role", "old_arg"], "left_anti")
        order = Window.partitionBy(*UNIT).orderBy("pred", F.col("kind") != "null_subject", "arg", "role")
        chosen = staged(found.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth"), "chosen")
        if chosen.isEmpty():
            dropped(before, chosen)
            break
        here = chosen.select(*UNIT)
        rows_open = staged(rows.join(here, list(UNIT), "left_semi"), "open")
        trial = staged(rewritten(rows_open, chosen), "trial")
        targets = staged(targets.join(here, list(UNIT), "left_semi"), "targets")
        after = staged(judge(trial, targets), "differences")
        gains = improved(before.join(here, list(UNIT), "left_semi"), after, UNIT)
        verdict = staged(chosen.join(gains, list(UNIT), "left").withColumn("kept", F.coalesce("improved", F.lit(False))).withColumn("round", F.lit(turn)).drop("improved"), "verdict")
        good = verdict.filter("kept").select(*UNIT)
        rows = staged(trial.join(good, list(UNIT), "left_semi").union(rows_open.join(good, list(UNIT), "left_anti")), "round")
        tried = staged(verdict if tried is None else tried.unionByName(verdict), "tried")
        dropped(before, chosen, rows_open, trial, after, verdict)
    if tried is None:
        return given.limit(0).select(*UNIT, "pred", F.lit("").alias("kind"), "role", "arg", F.lit(False).alias("kept"), F.lit(0).alias("round"))
    return tried.select(*UNIT, "pred", "kind", "role", "arg", "kept", "round")
