"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints that differ in at most three bits agree in one of four 16-bit blocks, so every distinct
fingerprint is dealt to four keys (block, value). Inside a key the fingerprints are sorted by Gray
rank and indexed as a tree: an upper node holds the masked bits that all below it share, a lower
node only the bits it adds, so a search adds up differences on its way down and drops whole groups
once they exceed three. A key with very many fingerprints is split by the blocks of the remaining
bits, which loses no pair. Tasks send on a spanning forest of what they find, never all pairs.

Defined results: null and blank texts have fingerprint zero and are linked like any other; repeated
rows are returned one by one; a null doc_id is no candidate for component_id unless it is alone;
other columns pass through ``keep_one`` whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import at, components, plain, restored, slices, staged, table, text_bytes

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: Rows of a key above which it is split by further blocks.
HOT_KEY = 50_000
#: Children of an index node, and rows of a search frontier held at once.
FAN, FRONTIER = 16, 1_000_000


def fingerprint(raw: bytes) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:], strict=False)]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(shingles), 65_536):
        h = np.array([digest(x, SEED) for x in shingles[at : at + 65_536]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, mark, fp)`` of whole texts, without a shuffle; mark is the hash of the text, fp the 64
    bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8_000_000):
                made = [fingerprint(x) for x in text_bytes(batch.column(2))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.int64())], ["doc_id", "mark", "fp"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, mark long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Rank of each 64-bit code in reflected Gray order."""
    r = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return r


class GrayIndex:
    """Tree over codes that are grouped by ``group`` (equal labels adjacent after sorting)."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes, group = codes[self.order], group[self.order]
        n = len(codes)
        levels = []
        low, high, labels = self.codes, self.codes, group
        while True:
            first = np.r_[True, labels[1:] != labels[:-1]] if len(labels) else np.zeros(0, bool)
            starts = np.flatnonzero(first)
            place = np.arange(len(labels)) - np.repeat(starts, np.diff(np.r_[starts, len(labels)]))
            cut = np.flatnonzero(place % FAN == 0)
            low, high = np.bitwise_and.reduceat(low, cut) if len(cut) else low, np.bitwise_or.reduceat(high, cut) if len(cut) else high
            labels = labels[cut]
            ends = np.r_[cut[1:], len(place)].astype(np.int64)
            mask = ~(low ^ high)
            levels.append({"from": cut.astype(np.int64), "to": ends, "mask": mask, "pattern": low & mask})
            if len(np.unique(labels)) == len(labels):
                break
        self.levels = levels[::-1]  # roots first: one node for each group
        for upper, lower in zip(self.levels, self.levels[1:], strict=False):
            above = np.repeat(upper["mask"], upper["to"] - upper["from"])
            lower["added"] = lower["mask"] & ~above
        self.levels[0]["added"] = self.levels[0]["mask"]
        self.last_added = ~np.repeat(self.levels[-1]["mask"], self.levels[-1]["to"] - self.levels[-1]["from"]) if n else codes
        self.roots = labels
        self.size = n
        self.root_of = np.searchsorted(labels, group) if n else np.zeros(0, np.int64)

    def pairs(self, radius: int = RADIUS, linked: np.ndarray | None = None, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs of sorted places (i < j) of one group that differ in ``radius`` bits or fewer.

        ``linked``: labels by sorted place; pairs with the same label are left out, and so are whole
        nodes of which all rows have the label of the query. ``asked``: flags by sorted place; only
        these are searched for, and j is any other place.
        """
        q = np.arange(self.size) if asked is None else np.flatnonzero(asked)
        known = self._labels(linked)
        first = q if linked is None else q[~self._all_linked(known, 0, linked, q, self.root_of)]
        stack = [(0, first, self.root_of[first], np.zeros(len(first), np.int64))]
        while stack:
            depth, q, node, acc = stack.pop()
            level = self.levels[depth]
            count = level["to"][node] - level["from"][node]
            total = int(count.sum())
            if total > FRONTIER and len(q) > 1:
                half = len(q) // 2
                stack += [(depth, q[:half], node[:half], acc[:half]), (depth, q[half:], node[half:], acc[half:])]
                continue
            start = np.repeat(level["from"][node] - (np.cumsum(count) - count), count)
            child = start + np.arange(total)
            q, acc = np.repeat(q, count), np.repeat(acc, count)
            if depth + 1 < len(self.levels):
                below = self.levels[depth + 1]
                acc = acc + np.bitwise_count((self.codes[q] ^ below["pattern"][child]) & below["added"][child])
                keep = acc <= radius
                if linked is not None:
                    keep &= ~self._all_linked(known, depth + 1, linked, q, child)
                if keep.any():
                    stack.append((depth + 1, q[keep], child[keep], acc[keep]))
            else:
                acc = acc + np.bitwise_count((self.codes[q] ^ self.codes[child]) & self.last_added[child])
                keep = (acc <= radius) & (q < child if asked is None else q != child)
                if linked is not None:
                    keep &= linked[q] != linked[child]
                if keep.any():
                    yield q[keep], child[keep]

    def _labels(self, linked: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Smallest and largest label below each node, by level."""
        out, low, high = [], linked, linked
        for level in reversed(self.levels) if linked is not None and self.size else ():
            low, high = np.minimum.reduceat(low, level["from"]), np.maximum.reduceat(high, level["from"])
            out.append((low, high))
        return out[::-1]

    @staticmethod
    def _all_linked(known, depth: int, linked: np.ndarray, q: np.ndarray, node: np.ndarray) -> np.ndarray:
        if not known:
            return np.zeros(len(q), bool)
        low, high = known[depth]
        return (low[node] == linked[q]) & (high[node] == linked[q])


def forest(n: int, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest place reachable from each place over the given pairs."""
    parent = np.arange(n)
    for i, j in blocks:
        while True:
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            a, b = parent[i], parent[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``(key, fp, rep)``, all rows of a key in this task: a spanning forest of close pairs."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    key, fp, rep = (t.column(c).to_numpy() for c in ("key", "fp", "rep"))
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    many = size[group] > 1
    group, fp, rep = group[many], fp[many].view(np.uint64), rep[many]
    if not len(fp):
        return
    index = GrayIndex(group, fp)
    root = forest(index.size, index.pairs())
    rep = rep[index.order]
    linked = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], ["a", "b"])


def _cut(fp, left: int, width: int):
    """``width`` bits of fp from bit ``left``."""
    return F.shiftrightunsigned(fp, left).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Edges ``(a, b)`` between the ids ``rep`` of distinct fingerprints within the radius."""
    spark = distinct.sparkSession
    fp = F.col("fp")
    keys = [F.struct(F.lit(b).cast("long").alias("taken"), F.xxhash64(F.lit(b), _cut(fp, 16 * b, 16)).alias("key")) for b in range(4)]
    keyed = distinct.select("fp", "rep", F.inline(F.array(*keys)))
    ready = []
    for width in (12, 9, None):
        if width is None:
            ready.append(keyed)
            break
        hot = staged(keyed.groupBy("key").count().filter(F.col("count") > hot_key).select("key", F.lit(True).alias("hot")), "hotkeys")
        if hot.isEmpty():
            ready.append(keyed)
            break
        marked = staged(keyed.join(hot, "key", "left"), "keyed")
        ready.append(marked.filter(F.col("hot").isNull()).drop("hot"))
        # what the key leaves free is cut anew: four blocks, of which close pairs share one
        free = _free(F.col("fp"), F.col("taken"), width)
        sub = [F.struct((F.col("taken") * 4 + b + 4).alias("taken"), F.xxhash64("key", F.lit(b), free[b]).alias("key")) for b in range(4)]
        keyed = marked.filter("hot").select("fp", "rep", F.inline(F.array(*sub)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = None
    for part in ready:
        # taken stays out: a key is one block of one value
        made = part.select("key", "fp", "rep").repartition(n, "key").mapInArrow(bucket_links, "a long, b long")
        found = made if found is None else found.union(made)
    return found


def _free(fp, taken, width: int) -> list:
    """Four blocks of ``width`` bits of what the key leaves free.

    The first split rotates fp so that the taken 16 bits come last and cuts the other 48; the second
    split also leaves out the 12 bits that the first one took.
    """
    first = taken if width == 12 else F.floor((taken - 4) / 4)
    rotated = F.expr("0L")
    for b in range(4):
        turn = 16 * (b + 1) % 64
        value = F.shiftrightunsigned(fp, turn).bitwiseOR(F.shiftleft(fp, 64 - turn)) if turn else fp
        rotated = F.when(first == b, value).otherwise(rotated)
    if width == 12:
        return [_cut(rotated, 12 * b, 12) for b in range(4)]
    second = F.pmod(taken, F.lit(4))
    rest = F.expr("0L")
    for b in range(4):
        low = rotated.bitwiseAND(F.lit((1 << 12 * b) - 1)) if b else F.expr("0L")
        high = F.shiftleft(_cut(rotated, 12 * (b + 1), 48 - 12 * (b + 1)), 12 * b) if b < 3 else F.expr("0L")
        rest = F.when(second == b, low.bitwiseOR(high)).otherwise(rest)
    return [_cut(rest, 9 * b, 9) for b in range(4)]


def _grouped(docs: DataFrame, doc_id: str, text: str, hot_key: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, mark, fp)``, and for each fingerprint ``(fp, group, component_id)``.

    Fingerprints are linked as such, so those that only rows without an id have join groups too.
    """
    marks = staged(fingerprints(docs, doc_id, text), "fingerprints")
    reps = staged(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(reps.select("fp", F.col("fp").alias("rep")), hot_key))
    grouped = staged(reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("group")), "grouped")
    named = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    return marks, staged(grouped.join(named, "group").select("fp", "group", "component_id"), "named")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``."""
    marks, named = _grouped(docs, doc_id, text, hot_key)
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


#: Bits of the map of ``sifted``: at most 262,144 words of it are broadcast.
SIEVE = 1 << 24


def sifted(rows: DataFrame, mark: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false only where ``mark`` is none of ``wanted(mark)``.

    A bitmap of fixed size, so whole texts that are not asked for need not be shuffled to a join.
    """
    place = lambda c: c.bitwiseAND(SIEVE - 1)
    bit = F.expr("shiftleft(1L, CAST(mark & 63 AS INT))")
    words = staged(wanted.select(F.shiftright(place(F.col("mark")), 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "sieve")
    joined = rows.withColumn("word", F.shiftright(place(mark), 6)).withColumn("turn", mark.bitwiseAND(63).cast("int")).join(F.broadcast(words), "word", "left")
    return joined.withColumn("maybe", F.coalesce(F.getbit("bits", F.col("turn")) == 1, F.lit(False))).drop("word", "turn", "bits")


def one_of_each(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component in ``groups(doc_id, mark, component)``, the one with the smallest id; columns of ``docs``.

    A row is known by its id and the hash of its text, so different texts under one id are judged each
    for itself and a row without an id stays only where no other row of its component has one.
    """
    row = F.struct(F.col("doc_id").isNull().alias("void"), F.col("doc_id").alias("best_id"), F.col("mark").alias("best_mark"))
    best = groups.groupBy("component").agg(F.min(row).alias("best")).select("component", "best.*")
    same = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("mark") == F.col("best_mark"))
    gone = staged(groups.join(best, "component").filter(~same).select(F.col("doc_id").alias("id"), "mark").distinct(), "gone")
    rows, own, t = plain(docs), at(docs, doc_id), F.xxhash64(at(docs, text))
    seen = sifted(rows, t, gone)
    held = seen.filter("maybe").join(gone, F.col(own).cast("long").eqNullSafe(F.col("id")) & (t == F.col("mark")), "left_anti")
    left = seen.filter("NOT maybe").union(held).drop("maybe")
    if not groups.groupBy("doc_id", "mark").count().filter("count > 1").isEmpty():
        left = left.withColumn("mark", t).dropDuplicates([own, "mark"])
    return restored(left, docs)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component; columns of ``docs``."""
    marks, named = _grouped(docs, doc_id, text, HOT_KEY)
    return one_of_each(docs, staged(marks.join(named, "fp").select("doc_id", "mark", F.col("group").alias("component")), "groups"), doc_id, text)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
