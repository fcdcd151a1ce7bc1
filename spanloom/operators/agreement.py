"""Whether subjects agree with their finite heads, and cases with relations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import flags, parts
from spanloom.operators.edges import UNIT, above_of, by_unit
from spanloom.operators.frames import with_children

#: Lemmas and flags that leave agreement open, and members of a coordination.
ANTECEDENT = ("che", "chi", "cui", "quale")
DISTRIBUTIVE = ("ciascuno", "ognuno", "catuno", "ambedue", "amendue", "uno", "tutto")
QUANTITY = ("molto",)
EXEMPT = ("AD_SENSUM", "FOREIGN")
MEMBERS = 16
#: The case that a relation calls for, cases that compete for a slot, and pairs that cannot be.
EXPECTED = {"obj": "accusative", "iobj": "dative", "nsubj": "nominative"}
CORE = ("nominative", "accusative", "dative")
IMPOSSIBLE = (("obl", "nominative"),)


def _flagged(note: Column, *names: str) -> Column:
    return F.arrays_overlap(flags(note), F.array(*map(F.lit, names)))


#: What agreement asks of the children of each token; ``others`` are the persons of the members of its coordination.
_BELOW = [
    T.StructField("n_nsubj", T.LongType()),
    *(T.StructField(n, T.BooleanType()) for n in ("cc", "linked", "comitative", "numbered", "measured", "attr_same", "impersonal")),
    T.StructField("others", T.ArrayType(T.StringType())),
]
#: What it asks of a head, and in which columns a subject has it.
_ASKED = ("pos", "number", "person", "note", "tense", "mood", "n_nsubj", "comitative", "attr_same", "impersonal")


def _told(columns: dict[str, pa.Array], base: np.ndarray, longest: int) -> dict[str, pa.Array]:
    """``_BELOW`` for all units of a batch at once, and under ``v_…`` what the head of each token has."""
    size, rel = len(base), columns["deprel"]
    above = above_of(columns["head"].to_numpy().astype(np.int64), base)
    child, h = above >= 0, np.maximum(above, 0)
    among = lambda *names: pc.is_in(rel, pa.array(names)).to_numpy(zero_copy_only=False)
    flag = lambda name: columns[name].to_numpy(zero_copy_only=False)

    def some(which: np.ndarray) -> pa.Array:
        out = np.zeros(size, bool)
        out[above[which & child]] = True
        return pa.array(out)

    number = pc.fill_null(columns["number"], "").dictionary_encode().indices.to_numpy()
    conj, end = among("conj"), np.arange(size)
    for _ in range(MEMBERS):
        end = np.where(conj[end] & child[end], above[end], end)
    members = np.flatnonzero(conj & (end != np.arange(size)))
    members = members[np.argsort(end[members], kind="stable")]
    starts = pa.array(np.searchsorted(end[members], np.arange(size + 1)), pa.int32())
    below = {
        "n_nsubj": pa.array(np.bincount(above[among("nsubj", "nsubj:pass") & child], minlength=size)),
        "cc": some(among("cc")),
        "linked": some(among("nmod", "conj", "appos")),
        "comitative": some(among("obl", "nmod") & flag("_with")),
        "numbered": some(among("nummod")),
        "measured": some(among("det", "amod") & flag("_much")),
        "attr_same": some(among("attr") & (number == number[h])),
        "impersonal": some(flag("_impersonal")),
        "others": pa.ListArray.from_arrays(starts, columns["_as"].take(pa.array(members))),
    }
    return below | {f"v_{c}": (below[c] if c in below else columns[c]).take(pa.array(h)) for c in _ASKED}


def agreed(tokens: DataFrame, pairs: DataFrame | None = None, keep: tuple[str, ...] = (), together: bool = False) -> DataFrame:
    """``(unit keys, u, head, deprel, keep, verdict, reason)`` of every token; both are null unless it is a subject
    with a head in its unit. With ``pairs(unit keys, subject, head)`` a row for each of these instead.

    Children, coordinations and heads are read from the arrays of a batch of whole units (``edges.by_unit``).
    """
    rel = F.col("deprel")
    flag = lambda c: F.coalesce(c, F.lit(False))
    rows = tokens.select(
        *UNIT, "u", "head", "deprel", "pos", "lemma", "number", "person", "note", "tense", "mood", *keep,
        flag(F.col("prep") == "con").alias("_with"), flag(F.col("lemma").isin(*QUANTITY)).alias("_much"),
        flag((rel == "expl:impers") | ((rel == "expl") & _flagged(F.col("note"), "impersonal"))).alias("_impersonal"),
        F.when(F.col("person") == "", "3").otherwise(F.col("person")).alias("_as"),
    )
    kind = {f.name: f.dataType for f in [*rows.schema.fields, *_BELOW]}
    known = by_unit(rows, UNIT, [*_BELOW, *(T.StructField(f"v_{c}", kind[c]) for c in _ASKED)], _told, together)
    subject = rel.isin("nsubj", "nsubj:pass") & (F.col("head") > 0)
    if pairs is not None:
        asked = pairs.select(*UNIT, F.col("subject").alias("u"), F.col("head").alias("asked"))
        heads = known.select(*UNIT, F.col("u").alias("asked"), *(F.col(c).alias(f"v_{c}") for c in _ASKED))
        own = known.drop(*(f"v_{c}" for c in _ASKED))
        known = own.join(asked, [*UNIT, "u"]).join(heads, [*UNIT, "asked"]).drop("head").withColumnRenamed("asked", "head")
        subject = F.lit(True)

    c = lambda name: F.coalesce(F.col(name), F.lit(False))
    person = F.when(F.col("person") == "", "3").otherwise(F.col("person"))
    fused = lambda x: F.col(f"{x}pos").contains("+") & (F.col(f"{x}tense") == "") & (F.col(f"{x}mood") == "")
    alone = F.size("others") == 0
    singular = (F.col("number") == "sg.") & (F.col("v_number") == "pl.")
    plural = (F.col("number") == "pl.") & (F.col("v_number") == "sg.")
    apart = (F.col("number") != "") & (F.col("v_number") != "") & (F.col("number") != F.col("v_number"))
    open_number = (
        F.when(singular & c("cc") & c("linked"), "coordination inside the subject")
        .when(singular & c("v_comitative"), "comitative phrase")
        .when(plural & (c("numbered") | c("measured")), "quantified subject")
        .when(apart & c("v_attr_same"), "predicate nominal")
        .when(plural & c("v_impersonal"), "impersonal")
    )
    reason = (
        F.when((F.col("v_person") == "") | ~F.col("v_pos").contains("verb"), "?head not finite")
        .when(fused("v_") | fused(""), "?fused token")
        .when(F.col("lemma").isin(*ANTECEDENT), "?person of the antecedent")
        .when(F.col("v_person").isin("1", "2") & (F.col("v_number") == "pl.") & person.isin("1", "2") & alone, "?member of a plural")
        .when(F.col("v_n_nsubj") > 1, "?several subjects")
        .when(_flagged(F.col("note"), *EXEMPT) | _flagged(F.col("v_note"), *EXEMPT), "?exempt")
        .when(F.col("lemma").isin(*DISTRIBUTIVE) & (F.col("v_number") == "pl."), "?distributive")
        .when(~alone & ((person == F.col("v_person")) | F.array_contains("others", F.col("v_person"))), "?coordinated subject")
        .when(~alone | (person != F.col("v_person")), "person")
        .when(open_number.isNotNull(), F.concat(F.lit("?"), open_number))
        .when(apart, "number")
        .otherwise("")
    )
    judged = known.select(*UNIT, "u", "head", "deprel", *keep, F.when(subject, reason).alias("reason"))
    verdict = F.when(F.col("reason") == "", "agree").when(F.col("reason").startswith("?"), "undecidable").when(F.col("reason").isNotNull(), "disagree")
    return judged.select(*UNIT, "u", "head", "deprel", *keep, verdict.alias("verdict"), F.ltrim(F.col("reason"), F.lit("?")).alias("reason"))


def agreement(edges: DataFrame, pairs: DataFrame | None = None, together: bool = False) -> DataFrame:
    """``(unit keys, subject, head, verdict, reason)`` of every subject with a head, or of the given
    ``pairs(unit keys, subject, head)``.

    The verdict is agree, disagree or undecidable; the branches are tried in a fixed order. A nominal
    without a person is third person; a coordination has the persons of all its members and no number.
    """
    rows = agreed(with_children(edges, together), pairs, together=together).filter("verdict IS NOT NULL")
    return rows.select(*UNIT, F.col("u").alias("subject"), "head", "verdict", "reason")


def adjudicated(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """``(unit keys, u, deprel, case, verdict)`` of ``cases(unit keys, u, case)`` against the relations of ``edges``."""
    return judged(cases.join(edges.select(*UNIT, "u", "deprel"), [*UNIT, "u"]))


def judged(rows: DataFrame) -> DataFrame:
    """``(unit keys, u, deprel, case, verdict)`` of rows with a case (joined by ``+``) and a relation.

    agree: one of the values is what the relation calls for; contradict: none is, and one competes for
    its slot; impossible: the pair cannot be; open: anything else.
    """
    values = parts(F.col("case"))
    want = F.element_at(F.create_map(*(F.lit(x) for pair in EXPECTED.items() for x in pair)), F.col("deprel"))
    cannot = F.lit(False)
    for rel, value in IMPOSSIBLE:
        cannot |= (F.col("deprel") == rel) & F.array_contains(values, value)
    asked = F.col("deprel").isin(*EXPECTED)
    verdict = (
        F.when(cannot, "impossible")
        .when(asked & F.array_contains(values, want), "agree")
        .when(asked & F.arrays_overlap(values, F.array(*map(F.lit, CORE))), "contradict")
        .otherwise("open")
    )
    return rows.select(*UNIT, "u", "deprel", "case", verdict.alias("verdict"))


def agreement_rates(verdicts: DataFrame) -> DataFrame:
    """Agreements, contradictions and the share of agreements by relation."""
    counts = verdicts.filter(F.col("deprel").isin(*EXPECTED)).groupBy("deprel").agg(F.count_if(F.col("verdict") == "agree").alias("agree"), F.count_if(F.col("verdict") == "contradict").alias("contradict"))
    total = F.col("agree") + F.col("contradict")
    return counts.withColumn("rate", F.when(total == 0, 0.0).otherwise(F.bround(F.col("agree") / total, 4)))
