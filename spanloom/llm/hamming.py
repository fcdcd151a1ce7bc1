"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

A code is cut into m segments, and for each segment there is a table from segment values to codes. A
code at distance d from a query agrees with it in some segment up to d // m bits. So the tables are
probed with the query's segment and all masks of r bits, for r = 0, 1, 2, …; after radius r all codes
closer than m * (r + 1) are known. Queries whose k-th verified distance is covered are finished; the
others go on with the next radius.

The tables lie in the shared folder in parts, one for each beginning of a segment (large ones split),
and stay there: a round shuffles the open queries to the parts that their masks reach, and a task
reads a part when it comes to its queries. A part's queries are dealt over several tasks.

Equal codes are one entry that keeps the smallest ids, as no more can be among the k nearest.

Defined results: neighbours are ordered by distance, then id; a query is not its own neighbour;
rows without a vector are neither queries nor neighbours; rows repeated with one id are one row;
where there are fewer than k others, all are returned. Only the columns that are named come in, so
other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import new_folder, opened, staged, table

BITS = 64
#: Codes in a part of a table, probes of a task at once, and most bits of a segment that name a part.
PART, CELLS, BEGIN = 200_000, 2_000_000, 16


def sign_codes(rows: DataFrame, vector: str = "embedding", id_: str = "vec_id", seed: int = 0) -> DataFrame:
    """``(id, code)``: one bit per component if there are 64, else per random hyperplane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            lists = batch.column(1).to_pylist()
            keep = [i for i, v in enumerate(lists) if v]
            codes = np.zeros(len(keep), np.int64)
            widths = {len(lists[i]) for i in keep}
            for width in widths:
                own = [k for k, i in enumerate(keep) if len(lists[i]) == width]
                x = np.array([[np.nan if c is None else c for c in lists[keep[k]]] for k in own], np.float64)
                if width != BITS:
                    x = np.nan_to_num(x) @ np.random.default_rng(seed).normal(size=(width, BITS))
                codes[own] = np.packbits(x > 0, axis=1, bitorder="little").view(np.int64)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(codes)], ["id", "code"])

    return rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, code long")


def entries(codes: DataFrame, k: int) -> DataFrame:
    """``(code, ids)`` with up to k smallest ids; every task first keeps only its own k smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            ids, own = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, own))
            ids, own = ids[order], own[order]
            fresh = np.r_[True, (own[1:] != own[:-1]) | (ids[1:] != ids[:-1])]
            ids, own = ids[fresh], own[fresh]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[place < k]), pa.array(own[place < k])], ["id", "code"])

    few = codes.mapInArrow(run, "id long, code long").distinct()
    ranked = few.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("n") <= k)
    return ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def segments(n: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment for n codes: about log2 n bits, so that a value names about
    one code, and 22 at most, so that a table of all values stays small."""
    m = min(8, max(3, round(BITS / math.log2(max(n, 2)))))
    cuts = [BITS * j // m for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=64)
def masks(width: int, weight: int) -> np.ndarray:
    """All numbers below 2 ** width with so many bits."""
    if not 0 < weight <= width:
        return np.zeros(int(weight == 0), np.int64)
    places = np.array(list(combinations(range(width), weight)), np.int64).reshape(-1, weight)
    return (np.int64(1) << places).sum(axis=1)


class Part:
    """The table of one part: codes in order of the low bits of a segment, and where each value starts."""

    def __init__(self, held: pa.Table, low: int, width: int):
        self.low, self.width = low, width
        codes, ids = held.column("code").to_numpy(), held.column("ids").combine_chunks()
        value = self.values(codes)
        order = np.argsort(value, kind="stable")
        self.codes = codes[order]
        self.starts = np.r_[0, np.cumsum(np.bincount(value, minlength=1 << width))]
        offsets, self.flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        self.first, self.many = offsets[:-1][order], np.diff(offsets)[order]

    def values(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def probe(self, q: np.ndarray, bound: np.ndarray, flips: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and distance of the k nearest among the codes under the flipped values."""
        probes = self.values(q)[:, None] ^ flips[None]
        count = (self.starts[probes + 1] - self.starts[probes]).ravel()
        hit = np.flatnonzero(count)
        count = count[hit]
        row = np.repeat(hit // max(len(flips), 1), count)
        entry = np.repeat(self.starts[probes.ravel()[hit]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        distance = np.bitwise_count((q[row] ^ self.codes[entry]).view(np.uint64)).astype(np.int64)
        good = distance <= bound[row]
        row, entry, distance = row[good], entry[good], distance[good]
        many = self.many[entry]
        ids = self.flat[np.repeat(self.first[entry] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        row, distance = np.repeat(row, many), np.repeat(distance, many)
        order = np.lexsort((ids, distance, row))
        row, ids, distance = row[order], ids[order], distance[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else order
        keep = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
        return q[row[keep]], ids[keep], distance[keep]


def _searcher(folder: str, cuts: list[tuple[int, int]], begin: int, k: int):
    """Probe the parts for queries ``(part, j, weight, code, bound)`` that are sorted by part and weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part = None, None
        for batch in batches:
            own, seg, weight = (batch.column(c).to_numpy() for c in ("part", "j", "weight"))
            code, bound = batch.column("code").to_numpy(), batch.column("bound").to_numpy()
            cuts_at = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (weight[1:] != weight[:-1])]) if len(own) else []
            for a, b in zip(cuts_at, [*cuts_at[1:], len(own)], strict=True):
                if own[a] != now:
                    now = own[a]
                    low, width = cuts[seg[a]]
                    system, base = opened(folder)
                    part = Part(pq.read_table(f"{base}/part={now}", columns=["code", "ids"], filesystem=system, partitioning=None), low, width - begin)
                flips = masks(part.width, int(weight[a]))
                if not len(flips):
                    continue
                step = max(1, CELLS // len(flips))
                for at in range(a, b, step):
                    found = part.probe(code[at : min(at + step, b)], bound[at : min(at + step, b)], flips, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query", "id", "distance"])

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int, most: int) -> DataFrame:
    """``(query, id, distance)``: the k nearest ids of each distinct query code.

    ``most``: how many ids there are in all.
    """
    spark = index.sparkSession
    n = max(index.count(), 1)
    cuts = segments(n)
    m, narrow, k = len(cuts), min(w for _, w in cuts), min(k, most)
    begin = min(max(0, math.ceil(math.log2(n / PART))), narrow - 1, BEGIN)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows once for each segment, with the first bits of the segment."""
        each = [F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("code", low + width - begin).bitwiseAND(F.lit((1 << begin) - 1)).alias("begin")) for j, (low, width) in enumerate(cuts)]
        return rows.select("*", F.inline(F.array(*each)))

    slices = F.ceil(F.col("count") / (2 * PART)).cast("int")
    sizes = staged(dealt(index.select("code")).groupBy("j", "begin").count().select("j", "begin", slices.alias("slices")), "parts")
    name = F.xxhash64("j", "begin", "slice")
    held = dealt(index).join(sizes, ["j", "begin"]).withColumn("slice", F.pmod(F.xxhash64("code"), F.col("slices")).cast("int"))
    folder = new_folder(spark, "tables")
    held.select(name.alias("part"), "code", "ids").repartition(shuffles, "part").write.partitionBy("part").parquet(folder)
    # few parts are read by several tasks each
    deals = max(1, math.ceil(2 * shuffles / max(sizes.agg(F.sum("slices")).first()[0] or 1, 1)))

    best = staged(queries.select(F.col("code").alias("query")).distinct().select("query", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("distance")), "best")
    left = staged(best.select(F.col("query").alias("code"), F.lit(BITS).alias("bound")), "open")
    by = Window.partitionBy("query").orderBy("distance", "id")
    done = []
    for radius in range(max(w for _, w in cuts) + 1):
        flips = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << begin) - 1).cast("long")), lambda x: F.bit_count(x) <= radius)
        asked = dealt(left).withColumn("flip", F.explode(flips)).withColumn("begin", F.col("begin").bitwiseXOR(F.col("flip")))
        asked = asked.join(sizes, ["j", "begin"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        asked = asked.select(name.alias("part"), "j", (F.lit(radius) - F.bit_count("flip")).alias("weight"), "code", F.col("bound").cast("long").alias("bound"))
        asked = asked.repartition(shuffles, "part", F.pmod(F.xxhash64("code"), F.lit(deals))).sortWithinPartitions("part", "weight")
        found = asked.mapInArrow(_searcher(folder, cuts, begin, k), "query long, id long, distance long")
        known = best.join(left.select(F.col("code").alias("query")), "query", "left_semi").filter("id is not null")
        best = staged(known.union(found).distinct().withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k).drop("n"), "best")
        kth = best.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("last"))
        state = left.join(kth, left.code == kth["query"], "left")
        covered = F.coalesce((F.col("n") >= k) & (F.col("last") < m * (radius + 1)), F.lit(False))
        bound = F.when(F.col("n") >= k, F.col("last")).otherwise(F.lit(BITS)).cast("int")
        if radius == max(w for _, w in cuts):
            done.append(best)
            break
        left = staged(state.filter(~covered).select("code", bound.alias("bound")), "open")
        done.append(best.join(left.select(F.col("code").alias("query")), "query", "left_anti"))
        if left.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``(query_id, rank, neighbor_id, distance)`` for ``rows(id, code)`` and ``queries(id, code)``."""
    index = staged(entries(rows, k + 1), "entries")
    most = rows.select("id").distinct().count()
    found = staged(nearest(index, queries, k + 1, most), "nearest") if most else None
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank long, neighbor_id long, distance long")
    pairs = queries.distinct().join(found, queries.code == found["query"]).filter(queries.id != found.id)
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    named = pairs.select(queries.id.alias("query_id"), found.id.alias("neighbor_id"), "distance")
    return named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def op2_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = staged(sign_codes(table(spark, sf_dir, "embeddings")), "codes")
    return top_k(codes, codes.filter("id % 20 = 0"))
