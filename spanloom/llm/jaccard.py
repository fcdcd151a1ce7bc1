"""SimHash near-dedup for a similarity threshold: the Gray-order index at a wide radius, then verification.

A text is its set of 5-word shingles; equal sets are one node, with the SimHash fingerprint of the set.
Sets with a Jaccard similarity of 0.8 differ in about ten of 64 bits (deviation three), so the index of
``simhash`` searches a radius of 22. Blocks of a fingerprint cannot deal out the work at that radius;
the nodes are dealt by MinHash bands instead (42 of six minima: a pair at 0.8 shares none with
probability 3e-6, a closer one with less), and in each bucket the Gray index finds the close pairs. Of
these, pairs whose sizes rule 0.8 out go, and those whose 256 one-bit minima differ in more than 50
places, five deviations above the mean at 0.8. The rest is verified on the sets themselves.

The Gray index is first searched for the smallest node of each bucket among the others. What this links is one
label in the index, which drops whole nodes of that label, so a large group of copies is not paired in full.

What is left are buckets with nodes of several labels. Nodes that such buckets connect are one family, which
one task gets, with each set once; families of very many shingles are cut into blocks that meet pairwise where
a bucket has nodes of both. The Gray index, the filters and the verification all run in that task and only a
spanning forest leaves it: texts of one template that are alike but below 0.8 make many pairs of few sets, and
no table of pairs is ever written.

Defined results: null and blank texts are one node, and so are texts with the same words in other
spacing or case. Of repeated, shared or null ids and of other columns see ``simhash.one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import simhash
from spanloom.llm.common import components, drop_staged, slices, staged, text_bytes

SHINGLE, LEAST, SEED, RADIUS = 5, 0.8, 42, 22
BANDS, ROWS, MINIMA, MOST_BITS = 42, 6, 256, 50
#: Shingles of a block of a family, and of all families that a task gets (8 bytes each).
FAMILY = 4_000_000
#: Nodes of a bucket in a block, and sets that a group of blocks is to have, where pairs are verified.
BLOCK, SETS = 256, 4096
_random = np.random.default_rng(SEED)
_MUL = _random.integers(0, 2**64, MINIMA, dtype=np.uint64) | np.uint64(1)
_ADD = _random.integers(0, 2**64, MINIMA, dtype=np.uint64)
_BITS = [f"b{i}" for i in range(MINIMA // 64)]
NODE = f"node long, n long, fp long, {', '.join(f'{b} long' for b in _BITS)}, keys array<long>"


def shingles(raw: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in each), np.uint64, len(each)))


def minima(found: np.ndarray) -> np.ndarray:
    low = np.full(MINIMA, 2**32 - 1, np.uint64)
    for at in range(0, len(found), 1024):
        low = np.minimum(low, ((found[at : at + 1024, None] * _MUL + _ADD) >> np.uint64(32)).min(axis=0))
    return low


def majority(found: np.ndarray) -> int:
    """SimHash of a set: the bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 65_536):
        ones += np.unpackbits(found[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(doc_id, mark, node, n, fp, b0 …, keys)`` of whole texts, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8_000_000):
                node, size, code, bits, keys = [], [], [], [], []
                for raw in text_bytes(batch.column(2)):
                    found = shingles(raw, width)
                    low = minima(found)
                    node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    size.append(len(found))
                    code.append(majority(found))
                    bits.append(np.packbits((low & np.uint64(1)).astype(np.uint8)).view(np.int64))
                    bands = low[: BANDS * ROWS].astype(np.uint32).reshape(BANDS, ROWS)
                    keys.append(np.array([xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(bands)], np.uint64).view(np.int64))
                columns = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(code, pa.int64())]
                columns += [pa.array(np.ascontiguousarray(x)) for x in np.array(bits, np.int64).reshape(-1, len(_BITS)).T]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "mark", "node", "n", "fp", *_BITS, "keys"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"doc_id long, mark long, {NODE}")


def buckets(nodes: DataFrame) -> DataFrame:
    """``(key, node, first)`` of all buckets of more than one node; first is the smallest of them."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    return keyed.join(firsts, "key")


def families(members: DataFrame, nodes: DataFrame, roots: DataFrame, size: int = FAMILY) -> DataFrame:
    """``(group, task, node, n, fp, root, b0 …)``: the nodes of buckets with several labels, by family.

    A family of up to ``size`` shingles is one task; of a larger one every two blocks are a task, which has
    the nodes that share a bucket with one of the other block. Tasks are put together in groups of about as
    many shingles.
    """
    rooted = members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("lead")).filter("low < high")
    rows = staged(rooted.join(mixed.select("key", "lead"), "key"), "mixed")
    of = components(rows.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()).select("node", F.col("root").alias("family"))
    told = staged(of.join(nodes.select("node", "n"), "node"), "families")
    blocks = told.groupBy("family").agg(F.ceil(F.sum("n") / size).cast("int").alias("blocks"))
    placed = staged(told.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "blocks")
    whole = placed.filter("blocks = 1").select(F.xxhash64("family").alias("task"), "node", "n")
    cut = rows.select("key", "node").join(placed.filter("blocks > 1"), "node")
    there = cut.groupBy("key").agg(F.collect_set("block").alias("others"))
    pairs = cut.join(there, "key").select("family", "node", "n", "block", F.explode("others").alias("other"))
    pairs = pairs.select(F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "node", "n").distinct()
    tasks = staged(whole.union(pairs), "tasks")
    groups = 1 + (tasks.agg(F.sum("n")).first()[0] or 0) // size
    labels = rows.select("node", "root").distinct()
    return tasks.drop("n").join(nodes.select("node", "n", "fp", *_BITS), "node").join(labels, "node").select(F.pmod("task", F.lit(groups)).alias("group"), "task", "node", "n", "fp", "root", *_BITS)


def family_links(found: DataFrame, sets: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """A spanning forest ``(a, b)`` of the pairs of one task, and different labels, at ``least`` or more.

    ``found`` as ``families`` gives it, ``sets(node, found)``.
    """

    def check(t: pa.Table) -> pa.Table:
        get = lambda c: t.column(c).to_numpy()
        index = simhash.GrayIndex(get("task"), get("fp").view(np.uint64))
        order = index.order
        node, n, root = get("node")[order], get("n")[order], get("root")[order]
        bits = np.stack([get(b)[order] for b in _BITS], axis=1).view(np.uint64)
        held = t.column("found").take(pa.array(order))
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        links = []
        for i, j in index.pairs(radius, root):
            fit = np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * least
            i, j = i[fit], j[fit]
            fit = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= MOST_BITS
            for a, b in zip(i[fit].tolist(), j[fit].tolist(), strict=True):
                if top(root[a]) == top(root[b]):
                    continue
                x, y = (np.frombuffer(held[k].as_buffer(), np.uint64) for k in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= least * (len(x) + len(y) - common):
                    up[top(root[b])] = top(root[a])
                    links.append((node[a], node[b]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return found.join(sets, "node").groupBy("group").applyInArrow(check, "a long, b long")


def led(members: DataFrame, nodes: DataFrame, least: float = LEAST, radius: int = RADIUS, hot: int = simhash.HOT_KEY) -> DataFrame:
    """``(bucket, a, b)``: of ``members(node, first)`` the pairs of a smallest node and one that shares a bucket with it
    which the Gray index finds within ``radius`` bits and neither sizes nor one-bit minima rule out.

    The nodes of one first are a group of the index, those of a first with more than ``hot`` several; the first is in each.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        get = lambda c: t.column(c).to_numpy()
        index = simhash.GrayIndex(np.unique(get("key"), return_inverse=True)[1], get("fp").view(np.uint64))
        order = index.order
        node, n = get("node")[order], get("n")[order]
        bits = np.stack([get(b)[order] for b in _BITS], axis=1).view(np.uint64)
        for i, j in index.pairs(radius, asked=node == get("first")[order]):
            fit = np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * least
            i, j = i[fit], j[fit]
            fit = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= MOST_BITS
            a, b = pa.array(node[i[fit]]), pa.array(node[j[fit]])
            yield pa.RecordBatch.from_arrays([a, a, b], ["bucket", "a", "b"])

    near = staged(members.select("first", "node").distinct(), "near")
    large = staged(near.groupBy("first").agg(F.count("*").alias("m")).filter(F.col("m") > hot), "large")
    parts = F.lit(1) if large.isEmpty() else F.coalesce(F.ceil(F.col("m") / hot).cast("int"), F.lit(1))
    sized = near if large.isEmpty() else near.join(large, "first", "left")
    block = F.explode(F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))))
    rows = sized.select("first", "node", block.alias("block")).select(F.xxhash64("first", "block").alias("key"), "first", "node")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.join(nodes.select("node", "n", "fp", *_BITS), "node").repartition(tasks, "key").mapInArrow(search, "bucket long, a long, b long")


def dealt(pairs: DataFrame, block: int = BLOCK, sets: int = SETS) -> tuple[DataFrame, DataFrame]:
    """``(group, a, b)``, and ``(group, node)`` of the sets that each group needs, once each.

    The nodes of a bucket are cut into blocks; the pairs of two blocks are together, and so many of these
    that a group needs about ``sets`` sets.
    """
    ends = pairs.select("bucket", F.col("a").alias("node")).union(pairs.select("bucket", F.col("b").alias("node"))).distinct()
    blocks = ends.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    of = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    task = F.xxhash64("bucket", F.least(of("a"), of("b")), F.greatest(of("a"), of("b")))
    tasked = staged(pairs.join(blocks, "bucket").select(task.alias("task"), "a", "b"), "tasks")
    needed = tasked.select("task", F.col("a").alias("node")).union(tasked.select("task", F.col("b").alias("node"))).distinct()
    group = F.pmod(F.col("task"), F.lit(1 + needed.count() // sets)).alias("group")
    return tasked.select(group, "a", "b"), needed.select(group, "node").distinct()


def shingle_sets(wanted: DataFrame, docs: DataFrame, marks: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``(node, found)``: the sets of the nodes ``wanted(node)``, from one text of each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [shingles(x, width).tobytes() for x in text_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "found"])

    known = staged(marks.groupBy("node").agg(F.min("mark").alias("mark")).join(wanted.select("node").distinct(), "node"), "ends")
    asked = simhash.sifted(docs.select(F.xxhash64(text).alias("mark"), F.col(text).alias("text")), F.col("mark"), known).filter("maybe")
    texts = asked.join(known, "mark").select("node", "text")
    return staged(texts.dropDuplicates(["node"]).mapInArrow(made, "node long, found binary"), "shingles")


def verified(pairs: DataFrame, docs: DataFrame, marks: DataFrame, text: str = "text", least: float = LEAST, width: int = SHINGLE) -> DataFrame:
    """A spanning forest of those of ``pairs(bucket, a, b)`` whose sets have a Jaccard similarity of ``least`` or more."""

    def check(asked: pa.Table, held: pa.Table) -> pa.Table:
        sets = dict(zip(held.column("node").to_pylist(), held.column("found").to_pylist(), strict=True))
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        links = []
        for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True):
            if top(a) == top(b):
                continue
            x, y = np.frombuffer(sets[a], np.uint64), np.frombuffer(sets[b], np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common >= least * (len(x) + len(y) - common):
                root[top(b)] = top(a)
                links.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    asked, needed = dealt(pairs)
    found = shingle_sets(needed, docs, marks, text, width)
    sent = needed.join(found, "node").select("group", "node", "found")
    return asked.groupBy("group").cogroup(sent.groupBy("group")).applyInArrow(check, "a long, b long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, mark, component)`` per row of ``docs``; mark is the hash of its text."""
    made = staged(sketches(docs, doc_id, text, width), "sketches")
    marks = made.select("doc_id", "mark", "node")
    nodes = staged(made.drop("doc_id", "mark").dropDuplicates(["node"]), "nodes")
    members = staged(buckets(nodes), "buckets")
    links = staged(verified(staged(led(members, nodes, least), "pairs"), docs, marks, text, least, width), "links")
    roots = staged(components(links), "roots")
    related = staged(families(members, nodes, roots), "related")
    links = links.union(staged(family_links(related, shingle_sets(related, docs, marks, text, width), least), "links"))
    roots = components(links)
    out = staged(marks.join(roots, "node", "left").select("doc_id", "mark", F.coalesce("root", "node").alias("component")), "copies")
    drop_staged(made, nodes, members, related)
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST, width: int = SHINGLE) -> DataFrame:
    """One row of each component of near copies; columns of ``docs``."""
    return simhash.one_of_each(docs, near_copies(docs, doc_id, text, least, width), doc_id, text)
