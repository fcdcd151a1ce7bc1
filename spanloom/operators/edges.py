"""Dependency edges inside units: children, structure checks and bounded walks.

A unit's tokens are numbered ``u`` = 1, 2, …; ``head`` is the number of the head, 0 for a root. Walks
run over the unit's array of heads, so they need one grouping and no join per step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = ("doc_id", "unit")
#: Steps of a walk.
WALK = 8
ARGUMENTS = ("nsubj", "nsubj:pass", "csubj", "csubj:pass", "obj", "iobj", "attr", "xcomp", "ccomp", "obl", "obl:agent")
COORDINATED, FUNCTION, PREPOSITION = ("conj", "appos", "flat", "compound"), ("aux", "aux:pass", "cop"), ("fixed", "case")


def children(edges: DataFrame, together: bool = False) -> DataFrame:
    """``(unit keys, u, n_children, n_subj, n_obj, n_case, n_aux)`` for tokens with children."""
    rel = F.col("deprel")
    if together:
        return _counted(edges)
    counts = {"n_subj": rel == "nsubj", "n_obj": rel == "obj", "n_case": rel == "case", "n_aux": rel.isin(*FUNCTION)}
    return edges.filter("head > 0").groupBy(*UNIT, F.col("head").alias("u")).agg(F.count("*").alias("n_children"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def _counted(edges: DataFrame) -> DataFrame:
    """``children`` of units whose rows stand together."""
    asked = {"n_subj": ["nsubj"], "n_obj": ["obj"], "n_case": ["case"], "n_aux": list(FUNCTION)}

    def found(columns: dict[str, pa.Array], base: np.ndarray, longest: int) -> dict[str, pa.Array]:
        head = columns["_head"].to_numpy()
        below = np.flatnonzero(head > 0)
        above, rel = (base + head - 1)[below], columns["_rel"].take(pa.array(below))
        count = lambda names: np.bincount(above[pc.is_in(rel, pa.array(names)).to_numpy(zero_copy_only=False)], minlength=len(base))
        return {"n_children": pa.array(np.bincount(above, minlength=len(base))), **{n: pa.array(count(names)) for n, names in asked.items()}}

    new = [T.StructField(n, T.LongType()) for n in ("n_children", *asked)]
    rows = edges.select(*UNIT, "u", F.col("head").cast("long").alias("_head"), F.col("deprel").alias("_rel"))
    return by_unit(rows, UNIT, new, found, True).filter("n_children > 0")


def with_head_word(edges: DataFrame, together: bool = False) -> DataFrame:
    """Edges with the word of their head; empty for roots. ``together``: see ``by_unit``; no head leaves its unit."""

    def found(columns: dict[str, pa.Array], base: np.ndarray, longest: int) -> dict[str, pa.Array]:
        head = columns["head"].to_numpy().astype(np.int64)
        words = columns["word"].take(pa.array(np.maximum(base + head - 1, 0)))
        return {"head_word": pc.if_else(pa.array(head > 0), words, "")}

    if together:
        return by_unit(edges, UNIT, [T.StructField("head_word", T.StringType())], found, True)
    heads = edges.select(*UNIT, F.col("u").alias("head"), F.col("word").alias("head_word"))
    return edges.join(heads, [*UNIT, "head"], "left").withColumn("head_word", F.coalesce("head_word", F.lit("")))


def unit_arrays(edges: DataFrame, together: bool = False) -> DataFrame:
    """Heads and relations of a unit by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, base in whole_units(batches, len(UNIT)):
            first = np.flatnonzero(base == np.arange(len(base)))
            ends = pa.array(np.append(first, len(base)), pa.int32())
            keys = [rows.column(k).take(pa.array(first)) for k in range(len(UNIT))]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.ListArray.from_arrays(ends, rows.column(c)) for c in ("head", "deprel"))], [*UNIT, "heads", "rels"])

    if together:
        kinds = [edges.schema[k].dataType.simpleString() for k in (*UNIT, "head")]
        return edges.select(*UNIT, "head", "deprel").mapInArrow(run, f"doc_id {kinds[0]}, unit {kinds[1]}, heads array<{kinds[2]}>, rels array<string>")
    rows = F.sort_array(F.collect_list(F.struct("u", "head", "deprel")))
    packed = edges.groupBy(*UNIT).agg(rows.alias("rows"))
    return packed.select(*UNIT, F.transform("rows", lambda r: r["head"]).alias("heads"), F.transform("rows", lambda r: r["deprel"]).alias("rels"))


def walk(start: Column, heads: Column, rels: Column, over: tuple[str, ...], steps: int = WALK) -> Column:
    """Where a walk along the given relations ends."""

    def step(at: Column, _: Column) -> Column:
        return F.when(F.element_at(rels, at).isin(*over) & (F.element_at(heads, at) > 0), F.element_at(heads, at)).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def walks(edges: DataFrame, together: bool = False) -> DataFrame:
    """Ends of the coordination, function-word and preposition walks of every token; its host: the end of
    the function-word walk from its head; and the top of its chain of conjuncts."""
    packed = unit_arrays(edges, together)
    each = packed.select(*UNIT, "heads", "rels", F.explode(F.sequence(F.lit(1), F.size("heads"))).alias("u"))
    ends = {"coord_head": COORDINATED, "aux_head": FUNCTION, "prep_head": PREPOSITION}
    head = F.element_at("heads", F.col("u"))
    host = F.when(head > 0, walk(F.greatest(head, F.lit(1)), F.col("heads"), F.col("rels"), FUNCTION)).otherwise(0)
    top = walk(F.col("u"), F.col("heads"), F.col("rels"), ("conj",), 16)
    return each.select(*UNIT, "u", *(walk(F.col("u"), F.col("heads"), F.col("rels"), over).alias(n) for n, over in ends.items()), host.alias("host"), top.alias("top"))


def whole_units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole units, whose first columns are the keys, and where each row's unit begins; the unit that is
    open at the end of a batch waits for the next one."""

    def begins(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
        """Whether a unit begins at each row; ``before`` ends with the row before the first one."""
        new = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            c = batch.column(k)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            new[0] |= before is None or c[0] != before.column(k)[-1]
        return new

    def joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.concat_batches(parts)
        starts = begins(rows, None)
        return rows, np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))

    unit: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.flatnonzero(begins(batch, unit[-1] if unit else None))
        if not len(at):
            unit.append(batch)
            continue
        if unit or at[-1]:
            yield joined([*unit, *([batch.slice(0, at[-1])] if at[-1] else [])])
        unit = [batch.slice(at[-1])]
    if unit:
        yield joined(unit)


def by_unit(tokens: DataFrame, keys: tuple[str, ...], new: list[T.StructField], found: Callable[[dict[str, pa.Array], np.ndarray, int], dict[str, pa.Array]], together: bool = False) -> DataFrame:
    """Tokens with new columns that depend on their whole unit; columns that begin with ``_`` go.

    Units are put together once, unless ``together`` says that the rows of each already follow each other in
    order of u. A task holds a batch of rows and the unit that is open at its end. ``found`` gets the columns
    of whole units, ordered by unit and u, where each token's unit begins, and the length of the longest one:
    whole arrays, no loop over units.
    """
    held = [c for c in tokens.columns if c not in (*keys, "u")]
    rows = tokens.select(*keys, "u", *held)
    rows = rows if together else rows.repartition(*keys).sortWithinPartitions(*keys, "u")
    shown = [f for f in tokens.schema.fields if f.name in held and not f.name.startswith("_")]
    out = T.StructType([*(tokens.schema[k] for k in keys), tokens.schema["u"], *shown, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, base in whole_units(batches, len(keys)):
            made = found({c: rows.column(c) for c in ("u", *held)}, base, int((np.arange(len(base)) - base).max()) + 1)
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in (*keys, "u", *(f.name for f in shown))] + [made[f.name] for f in new], out.names)

    return rows.mapInArrow(run, out)


def climbed(above: np.ndarray, may: Callable[[np.ndarray], np.ndarray], steps: int = WALK) -> np.ndarray:
    """Where bounded walks from all tokens end that leave a place only if ``may`` and never come back to one."""
    at, live, seen = np.arange(len(above)), np.ones(len(above), bool), [np.arange(len(above))]
    for _ in range(steps):
        to = above[at]
        live = live & (to >= 0) & may(at)
        for s in seen:
            live = live & (to != s)
        at = np.where(live, to, at)
        seen.append(at)
    return at


def guarded(columns: dict[str, pa.Array], base: np.ndarray, longest: int) -> dict[str, pa.Array]:
    """``guarded_walks`` for all units of a batch at once."""
    head = columns["head"].to_numpy().astype(np.int64)
    above = np.where(head > 0, base + head - 1, -1)
    h = np.maximum(above, 0)
    rel, verb = columns["deprel"], columns["verb"].to_numpy(zero_copy_only=False)
    among = lambda names: pc.is_in(rel, pa.array(names)).to_numpy(zero_copy_only=False)
    leaves = among(["conj"]) & ~verb & verb[h] & ~among(ARGUMENTS)[h] & (above >= 0)
    coordinated, prepositional, fixed = among(COORDINATED), among(PREPOSITION), among(["fixed"])
    stacked = np.zeros(len(head), bool)
    stacked[above[fixed & (above >= 0)]] = True
    moves = fixed | (among(["case"]) & stacked)
    ends = {
        "coord_head": climbed(above, lambda at: (coordinated & ~leaves)[at]),
        "nominal": np.where(moves, climbed(above, lambda at: prepositional[at]), np.arange(len(head))),
        "coord_any": climbed(above, lambda at: coordinated[at]),
        "aux_place": climbed(above, lambda at, f=among(FUNCTION): f[at]),
    }
    return {name: pa.array((end - base + 1).astype(np.int32)) for name, end in ends.items()}


def guarded_walks(edges: DataFrame) -> DataFrame:
    """``(unit keys, u, coord_head, nominal, coord_any, aux_place)``: walks that stop where the tree says so.

    The coordination walk ends where a conjunct that is no verb hangs on a verb that is no argument
    (``coord_any`` does not); the preposition walk leaves a lone preposition, one without a fixed part,
    where it is; ``aux_place`` is the end of the walk over function words. All end before a place that they
    have seen.
    """
    from spanloom.functions.text import is_verb

    known = edges.select(*UNIT, "u", "head", "deprel", is_verb(F.col("pos")).alias("verb"))
    new = [T.StructField(n, T.IntegerType()) for n in ("coord_head", "nominal", "coord_any", "aux_place")]
    return by_unit(known, UNIT, new, guarded).drop("head", "deprel", "verb")


def reaches_root(edges: DataFrame, together: bool = False) -> DataFrame:
    """``(unit keys, u, rooted)``: whether following heads ends at a root.

    Heads are doubled (the head of the head), so a unit of n tokens takes log2 n steps.
    """
    packed = unit_arrays(edges, together).withColumn("n", F.size("heads"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") + 1)).cast("int"))
    jump = lambda h: F.transform(h, lambda x: F.when(x == 0, 0).otherwise(F.element_at(h, F.greatest(x, F.lit(1)))))
    far = F.aggregate(steps, F.col("heads"), lambda h, _: jump(h))
    return packed.select(*UNIT, F.posexplode(far).alias("at", "far")).select(*UNIT, (F.col("at") + 1).alias("u"), (F.col("far") == 0).alias("rooted"))


def above_of(head: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The row of each token's head in a batch of whole units; -1 for roots and heads beyond the unit."""
    lengths = np.diff(np.append(np.flatnonzero(base == np.arange(len(base))), len(base)))
    return np.where((head > 0) & (head <= np.repeat(lengths, lengths)), base + head - 1, -1)


def ends_at_root(above: np.ndarray, longest: int) -> np.ndarray:
    """Whether following heads leaves every cycle, by doubling."""
    for _ in range(longest.bit_length() + 1):
        above = np.where(above >= 0, above[np.maximum(above, 0)], -1)
    return above < 0


def structure_violations(edges: DataFrame, together: bool = False) -> DataFrame:
    """One long table ``(unit keys, u, kind)``: root count, root label, self heads, cycles, double objects.

    All is told by the arrays of a batch of units in one pass; ``together``: see ``by_unit``.
    """

    def found(columns: dict[str, pa.Array], base: np.ndarray, longest: int) -> dict[str, pa.Array]:
        head = columns["head"].to_numpy().astype(np.int64)
        above, size = above_of(head, base), len(base)
        objects = above[(above >= 0) & pc.equal(columns["deprel"], "obj").to_numpy(zero_copy_only=False)]
        return {"roots": pa.array(np.bincount(base[head == 0], minlength=size)[base]), "rooted": pa.array(ends_at_root(above, longest)), "n_obj": pa.array(np.bincount(objects, minlength=size))}

    new = [T.StructField("roots", T.LongType()), T.StructField("rooted", T.BooleanType()), T.StructField("n_obj", T.LongType())]
    known = by_unit(edges.select(*UNIT, "u", "head", "deprel"), UNIT, new, found, together)
    u = F.col("u")
    kinds = {
        "root_label": (F.col("head") == 0) != (F.col("deprel") == "root"),
        "self_head": F.col("head") == u,
        "cycle": ~F.col("rooted"),
        "double_obj": F.col("n_obj") > 1,
    }
    row = lambda when, at, kind: F.when(when, F.struct(at.cast(edges.schema["u"].dataType).alias("u"), kind.alias("kind")))
    counted = row((u == 1) & (F.col("roots") != 1), F.lit(0), F.when(F.col("roots") == 0, "no_root").otherwise("many_roots"))
    return known.select(*UNIT, F.inline(F.array_compact(F.array(counted, *(row(c, u, F.lit(k)) for k, c in kinds.items())))))


def subtree_starts(edges: DataFrame, together: bool = False) -> DataFrame:
    """``(unit keys, u, first, size)``: smallest token and number of tokens at or below each token.

    Leaves hand what is below them to their heads until only cycles are left, so a unit takes time in
    proportion to its length. All tokens of a cycle are below each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for doc, unit, heads in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                first, size = below(heads)
                n = len(heads)
                for column, values in zip(out, ([doc] * n, [unit] * n, range(1, n + 1), first, size), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "unit", "u", "first", "size"])

    packed = unit_arrays(edges, together).select(*(F.col(c).cast("long") for c in UNIT), "heads")
    return packed.mapInArrow(run, "doc_id long, unit long, u long, first long, size long")


def below(heads: list[int]) -> tuple[list[int], list[int]]:
    """Smallest token and number of tokens at or below each token, by place."""
    n = len(heads)
    first, size, waits = list(range(1, n + 1)), [1] * n, [0] * n
    for h in heads:
        if h:
            waits[h - 1] += 1
    ready = [i for i in range(n) if not waits[i]]
    for i in ready:  # grows while it is read
        if heads[i]:
            h = heads[i] - 1
            first[h], size[h], waits[h] = min(first[h], first[i]), size[h] + size[i], waits[h] - 1
            if not waits[h]:
                ready.append(h)
    for i in range(n):
        if waits[i]:
            ring = [i]
            while (h := heads[ring[-1]] - 1) != i:
                ring.append(h)
            least, total = min(first[k] for k in ring), sum(size[k] for k in ring)
            for k in ring:
                first[k], size[k], waits[k] = least, total, 0
    return first, size


def finite_features(edges: DataFrame) -> DataFrame:
    """``(unit keys, u, person, number)`` of a token, from itself or from its first finite function word."""
    child = edges.filter(F.col("deprel").isin(*FUNCTION) & (F.col("head") > 0) & (F.col("person") != ""))
    first = child.groupBy(*UNIT, F.col("head").alias("u")).agg(F.min_by(F.struct("person", "number"), "u").alias("aux"))
    own = F.col("person") != ""
    picked = lambda c: F.when(own, F.col(c)).otherwise(F.coalesce(F.col(f"aux.{c}"), F.lit("")))
    return edges.join(first, [*UNIT, "u"], "left").select(*UNIT, "u", picked("person").alias("person"), picked("number").alias("number"))


def antecedents(edges: DataFrame) -> DataFrame:
    """``(unit keys, u, antecedent)``: the head of every relative clause."""
    return edges.filter("deprel = 'acl:relcl' and head > 0").select(*UNIT, "u", F.col("head").alias("antecedent"))


def conjunct_clusters(edges: DataFrame, steps: int = 16, together: bool = False) -> DataFrame:
    """``(unit keys, u, top)`` of all tokens in a coordination: members and the token they hang on.

    A unit's members are put together and made distinct in its own row, without a shuffle."""
    packed = unit_arrays(edges, together)
    places = F.filter(F.sequence(F.lit(1), F.size("heads")), lambda u: F.element_at("rels", u) == "conj")
    pair = lambda u, top: F.struct(u.cast("int").alias("u"), top.cast("int").alias("top"))
    members = F.transform(places, lambda u: pair(u, walk(u, F.col("heads"), F.col("rels"), ("conj",), steps)))
    held = packed.select(*UNIT, members.alias("members"))
    return held.select(*UNIT, F.inline(F.array_distinct(F.concat("members", F.transform("members", lambda m: pair(m["top"], m["top"]))))))


def conjunct_resolves(edges: DataFrame, clauses: tuple[str, ...], steps: int = 16, together: bool = False) -> DataFrame:
    """``(unit keys, u, resolves)``: whether the chain of conjuncts of a token hangs on a clause head.

    A token with one of the relations ``clauses`` is one; the chain goes on over heads that are
    conjuncts themselves.
    """
    packed = unit_arrays(edges, together)
    each = packed.select(*UNIT, "heads", "rels", F.explode(F.sequence(F.lit(1), F.size("heads"))).alias("u")).filter(F.element_at("rels", F.col("u")) == "conj")
    state = F.struct(F.col("u").alias("at"), F.lit(False).alias("met"))

    def step(a: Column, _: Column) -> Column:
        head = F.element_at("heads", a["at"])
        rel = F.when(head > 0, F.element_at("rels", F.greatest(head, F.lit(1)))).otherwise("")
        on = ~a["met"] & (F.element_at("rels", a["at"]) == "conj") & (head > 0)
        return F.struct(F.when(on, head).otherwise(a["at"]).alias("at"), (a["met"] | (on & rel.isin(*clauses))).alias("met"))

    return each.select(*UNIT, "u", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)["met"].alias("resolves"))


def preposition_stacks(edges: DataFrame, steps: int = WALK) -> DataFrame:
    """``(unit keys, u, lemmas)``: forms of all prepositions below a token, also of those that hang on a
    preposition, and of fixed parts of one."""
    from spanloom.functions.text import normal_preposition

    forms = F.transform(F.sort_array(F.collect_list(F.struct("u", F.lower("word").alias("form")))), lambda x: x["form"])
    packed = unit_arrays(edges).join(edges.groupBy(*UNIT).agg(forms.alias("forms")), list(UNIT))
    each = packed.select(*UNIT, "heads", "rels", "forms", F.explode(F.sequence(F.lit(1), F.size("heads"))).alias("u")).filter(F.element_at("rels", F.col("u")).isin("case", "fixed"))
    rel = lambda at: F.element_at("rels", at)
    head = lambda at: F.element_at("heads", at)

    def step(a: Column, _: Column) -> Column:
        at, up = a["at"], head(a["at"])
        on = a["live"] & (up > 0) & ((rel(at) == "case") | ((rel(at) == "fixed") & (rel(F.greatest(up, F.lit(1))) == "case"))) & ~F.array_contains(a["seen"], up)
        return F.struct(F.when(on, up).otherwise(at).alias("at"), on.alias("live"), F.when(on, F.concat(a["seen"], F.array(up))).otherwise(a["seen"]).alias("seen"))

    start = F.struct(F.col("u").alias("at"), F.lit(True).alias("live"), F.array().cast("array<int>").alias("seen"))
    above = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["seen"]
    rows = each.select(*UNIT, normal_preposition(F.element_at("forms", F.col("u"))).alias("form"), F.explode(above).alias("u"))
    return rows.groupBy(*UNIT, "u").agg(F.array_join(F.sort_array(F.collect_set("form")), "+").alias("lemmas"))


def resolved(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Rows that name a head by number and word: ``status`` is root, ok, no_such_token or word_differs."""
    named = words.select(*UNIT, F.col("u").alias("head"), F.col("word").alias("there"))
    joined = rows.join(named, [*UNIT, "head"], "left")
    status = F.when(F.col("head") == 0, "root").when(F.col("there").isNull(), "no_such_token").when(F.lower("there") == F.lower("head_word"), "ok").otherwise("word_differs")
    return joined.withColumn("status", status).drop("there")
