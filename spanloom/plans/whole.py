"""Queries over whole units: what each asks of a batch (``layers.whole``), and the counts of that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spanloom.functions import text as fn
from spanloom.operators import batches as bt
from spanloom.operators import derivation, frames, validate
from spanloom.operators.batches import Batch, Rows, strings
from spanloom.plans import layers

KEYS = "doc_id long, unit int"


def placed(b: Batch, at: np.ndarray) -> dict[str, pa.Array]:
    return b.keys(at) | {"u": pa.array(b.u[at], pa.int32())}


def per_document(b: Batch, kinds: list[str], found: list[np.ndarray]) -> dict[str, pa.Array]:
    """How many of the places ``found`` of each kind a row of ``documents`` has."""
    rows = np.cumsum(np.diff(b.doc, prepend=b.doc[0] - 1) != 0) - 1
    at = np.concatenate(found)
    (doc, kind), n = bt.counted(rows[b.of[at]], np.repeat(np.arange(len(kinds)), list(map(len, found))))
    first = b.doc[np.flatnonzero(np.diff(rows, prepend=-1))]
    return {"doc_id": pa.array(first[doc], pa.int64()), "kind": strings(kind, kinds), "n": pa.array(n, pa.int64())}


def per_unit(b: Batch, **flags: np.ndarray) -> dict[str, pa.Array]:
    """Sums of flags of units by row of ``documents``."""
    starts = np.flatnonzero(np.diff(b.doc, prepend=b.doc[0] - 1))
    return {"doc_id": pa.array(b.doc[starts], pa.int64())} | {k: pa.array(np.add.reduceat(v.astype(np.int64), starts), pa.int64()) for k, v in flags.items()}


def summed(rows, *keys: str):
    """Counts of batches added up."""
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in rows.columns if c not in keys))


def counts(values: np.ndarray, names: list[str], column: str) -> dict[str, pa.Array]:
    n = np.bincount(values, minlength=len(names))
    there = np.flatnonzero(n)
    return {column: strings(there, names), "n": pa.array(n[there], pa.int64())}


def kinds_of(spark, sf, faults):
    """``(doc_id, kind, severity, n)`` of ``faults(batch)``: kinds with places."""

    def found(b):
        made = faults(b)
        return per_document(b, [k for k, _ in made], [at for _, at in made])

    rows = summed(layers.whole(spark, sf, found, "doc_id long, kind string, n long"), "doc_id", "kind")
    return rows.select("doc_id", "kind", validate.severity(F.col("kind")).alias("severity"), "n")


def frame_rows(b: Batch, rows: Rows) -> dict[str, pa.Array]:
    return b.keys(rows.pred) | {"pred": pa.array(b.u[rows.pred], pa.int32()), "role": strings(rows.role, b.roles), "arg": pa.array(rows.arg, pa.int32())}
