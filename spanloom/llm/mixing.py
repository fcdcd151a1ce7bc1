"""Mixing sources to target weights by temperature, with DataFrame functions only.

The token share p of each source is raised to an exponent between 0 (all sources alike) and 1 (as
they are). The exponent is bisected until the weights have a target entropy, and further if a source
would then be repeated more often than allowed. A source's weight times the budget, over its tokens,
says how often it is read. Every reading goes through its blocks in an order of its own; the last
one stops where the budget ends. ``place`` puts all sources on one line so that any stretch of it
holds them in their weights.

Which documents the last reading takes follows from three numbers per source, so texts are never
shuffled to mix them. Where it stops is found in three levels of running sums: over equal stretches of
the places of a source's blocks, over the blocks of one stretch, over the documents of one block. So a
source of any size costs a task no more than its share of each.

Defined results: a null source is a source; documents without words cost nothing and are read with
their block; a source without any word is read once; repeated rows are read alike; an empty table
gives an empty mix; other columns keep their names and values whatever the names are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import WORD, at, drop_staged, plain, restored, staged, table

#: Target entropy as a share of the greatest possible one, and most readings of a source.
ENTROPY, MAX_REPEATS = 0.9, 4.0
#: Tokens of a block, halvings of the exponent's interval in each pass and passes.
BLOCK_TOKENS, HALVINGS, PASSES = 100_000, 6, 5
#: Stretches of places of which each source's blocks are summed first.
STRETCHES = 4096
SEED = 7


def source_tokens(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """``(source, tokens, share)`` per source; combined before the shuffle."""
    sums = staged(docs.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens")), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    return sums.withColumn("share", F.col("tokens") / F.lit(max(total, 1)))


def at_exponents(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """(entropy, most readings, sum) of the weights for each exponent, in one pass over the sources."""
    grid = shares.filter("share > 0").select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    power = F.pow("share", F.col("a"))
    rows = grid.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("l"), F.max(F.pow("share", F.col("a") - 1)).alias("m")).collect()
    by = {r.a: (math.log(r.z) - r.a * r.l / r.z, r.m / r.z, r.z) for r in rows}
    return [by[a] for a in exponents]


def bisect(shares: DataFrame, wanted, good: float, bad: float) -> float:
    """Between an exponent that ``wanted`` accepts and one that it may not, the last one accepted.

    Each pass over the sources tries all midpoints of several halvings.
    """
    n = 1 << HALVINGS
    for _ in range(PASSES):
        points = [good + (bad - good) * k / n for k in range(n + 1)]
        accepted = [wanted(*x) for x in at_exponents(shares, points)]
        k = next((i for i in range(1, n + 1) if not accepted[i]), None)
        if k is None:
            return bad
        good, bad = points[k - 1], points[k]
    return good


def exponent(shares: DataFrame, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS, readings: float = 1.0) -> float:
    """The largest exponent whose weights reach the entropy (a share of the logarithm of the number of
    sources); if that reads a source too often, the smallest one that does not."""
    n = shares.filter("share > 0").count()
    if n < 2:
        return 1.0
    found = 1.0 if entropy is None else bisect(shares, lambda h, m, z: h >= entropy * math.log(n) - 1e-12, 0.0, 1.0)
    if max_repeats is not None and at_exponents(shares, [found])[0][1] * readings > max_repeats:
        found = bisect(shares, lambda h, m, z: m * readings <= max_repeats, 1.0, found)
    return found


def _part(seed: int, *columns: Column | str) -> Column:
    """A keyed number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _block(readings: Column) -> tuple[Column, Column]:
    """Block of a document, and the place of the block in that reading."""
    block = F.pmod(F.shiftrightunsigned("__mix_doc", 1), F.col("__mix_blocks"))
    return block, _part(SEED, "__mix_source", block, readings)


def plan(sizes: DataFrame, entropy: float | None = ENTROPY, max_repeats: float | None = MAX_REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per source from ``sizes(__mix_source, __mix_doc, __mix_tokens)``: blocks, exact number of
    readings, full readings, and where the last one stops (place of a block, document in it)."""
    shares = source_tokens(sizes, "__mix_source", "__mix_tokens")
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    a = exponent(shares, entropy, max_repeats, budget / max(total, 1))
    z = at_exponents(shares, [a])[0][2] if total else 1.0
    readings = F.when(F.col("tokens") > 0, F.pow("share", F.lit(a)) / F.lit(z) * F.lit(float(budget)) / F.col("tokens")).otherwise(1.0)
    rows = shares.select(F.col("source").alias("__mix_source"), F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).alias("__mix_blocks"), readings.alias("__mix_readings"), "tokens")
    rows = staged(rows.withColumn("__mix_full", F.floor(F.col("__mix_readings") + 1e-9)), "readings")

    block, place = _block(F.col("__mix_full"))
    dealt = _with_source(sizes, rows).select("__mix_source", "__mix_doc", "__mix_tokens", "tokens", "__mix_readings", "__mix_full", block.alias("block"), place.alias("place"))
    dealt = staged(dealt, "dealt")
    room = F.round((F.col("__mix_readings") - F.col("__mix_full")) * F.col("tokens")).cast("long")
    blocks = dealt.groupBy("__mix_source", "block").agg(F.sum("__mix_tokens").alias("n"), F.first("place").alias("place"), F.first(room).alias("room"))
    blocks = staged(blocks.withColumn("stretch", F.floor(F.col("place") * STRETCHES)), "blocks")
    wide = blocks.groupBy("__mix_source", "stretch").agg(F.sum("n").alias("n"), F.first("room").alias("room"))
    stretch = _crossing(wide, "stretch", ["stretch"])
    inner = blocks.join(stretch.select(F.col("s"), F.col("edge").alias("e"), "rest"), blocks["__mix_source"].eqNullSafe(F.col("s")) & (blocks.stretch == F.col("e")))
    edge = staged(_crossing(inner.select("__mix_source", "block", "n", "place", F.col("rest").alias("room")), "block", ["place", "block"]), "edges")
    inside = dealt.join(edge, dealt["__mix_source"].eqNullSafe(edge.s) & (dealt.block == edge.edge))
    upto = Window.partitionBy("__mix_source").orderBy("__mix_doc")
    last = inside.withColumn("used", F.sum("__mix_tokens").over(upto)).filter("used <= rest").groupBy("s").agg(F.max("__mix_doc").alias("__mix_last"))
    cut = inside.groupBy("s").agg(F.first("place").alias("__mix_stop"))
    cut = cut.join(last, cut.s.eqNullSafe(last.s), "left").select(cut.s, "__mix_stop", "__mix_last")
    out = staged(rows.join(cut, rows["__mix_source"].eqNullSafe(cut.s), "left").drop("s", "tokens"), "plan")
    drop_staged(dealt, blocks, edge, rows)
    return out


def _crossing(sums: DataFrame, what: str, order: list[str]) -> DataFrame:
    """``(s, edge, rest)``: the part of each source in which the running sum of ``n`` passes ``room``, and
    how much room there is in it."""
    upto = Window.partitionBy("__mix_source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    edge = before.filter("room > 0 and before <= room and before + n > room").select(F.col("__mix_source").alias("s"), F.col(what).alias("edge"), (F.col("room") - F.col("before")).alias("rest"))
    return edge.groupBy("s").agg(F.min_by("edge", "rest").alias("edge"), F.min("rest").alias("rest"))


def _with_source(docs: DataFrame, rows: DataFrame) -> DataFrame:
    right = rows.withColumnRenamed("__mix_source", "__mix_right")
    return docs.join(right, F.col("__mix_source").eqNullSafe(F.col("__mix_right"))).drop("__mix_right")


def mixed(docs: DataFrame, sizes: DataFrame, **options) -> DataFrame:
    """``docs`` (with ``__mix_source`` and ``__mix_doc``) once for every reading that takes the row, with
    ``__mix_epoch``, ``__mix_block`` and ``__mix_place``."""
    rows = plan(sizes, **options)
    block, place = _block(F.col("__mix_full"))
    stop, doc = F.col("__mix_stop"), F.col("__mix_doc")
    # without an edge there is no last reading but the full ones
    partly = (place < stop) | ((place == stop) & (doc <= F.col("__mix_last")))
    times = F.col("__mix_full") + F.coalesce(partly, F.lit(False)).cast("long")
    taken = _with_source(docs, rows).withColumn("__mix_times", times).filter("__mix_times > 0")
    each = taken.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_times") - 1)))
    block, place = _block(F.col("__mix_epoch"))
    spot = (F.col("__mix_epoch") + place) / F.greatest("__mix_readings", F.col("__mix_times").cast("double"))
    return each.withColumn("__mix_block", block).withColumn("__mix_place", spot).drop("__mix_blocks", "__mix_readings", "__mix_full", "__mix_stop", "__mix_last", "__mix_times")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prepared(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the columns that mixing needs."""
    return docs.withColumn("__mix_source", F.col(source).cast("string")).withColumn("__mix_doc", F.xxhash64(F.lit(SEED), F.col(doc_id), F.col(text)))


def remixed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix as rows of ``docs``, each as often as it is read."""
    own = at(docs, text)
    ready = prepared(plain(docs), at(docs, source), at(docs, doc_id), own)
    sizes = staged(ready.select("__mix_source", "__mix_doc", tokens(F.col(own)).alias("__mix_tokens")), "sizes")
    out = restored(mixed(ready, sizes, **options), docs)
    drop_staged(sizes)
    return out


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every document of the mix, from one pass over the texts."""
    docs = prepared(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    sizes = staged(docs.select("doc_id", "__mix_source", "__mix_doc", tokens(F.col("text")).alias("__mix_tokens")), "sizes")
    out = mixed(sizes, sizes.drop("doc_id"))
    return out.select("doc_id", F.col("__mix_source").alias("source"), F.col("__mix_tokens").alias("n_tokens"), F.col("__mix_epoch").alias("epoch"), F.col("__mix_block").alias("block"), F.col("__mix_place").alias("place"))
