"""Phrase collocations by mergeable Misra-Gries summaries, level by level.

Level n looks at phrases of n words of which both parts of n - 1 words were found frequent. Two passes:

1. Tasks count the 64-bit names of their phrases; the counts go to hash partitions. A partition keeps a
   Misra-Gries summary of more counters than its mass divided by the threshold. Summaries are merged by
   adding counters and taking off the first one that has no room, so every phrase that reaches the
   threshold survives whatever the order. A name that is shared by two phrases only lets more survive.
2. Phrases whose names survive are counted exactly, by their words.

Survivors reach the tasks as one bitmap of fixed size. Where it fills up with growing input more phrases
are counted in the second pass; none is lost.

Everything is per language. Defined results: a null text is empty; a null language is ``und``; repeated
rows count each time; a table without phrases gives no rows. Only the columns that are named come in,
so other columns cannot clash. A phrase never spans a break (``BREAKS``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import drop_staged, slices, staged, table

#: Characters between pieces, longest phrase, lowest count, share in percent at which a
#: longer phrase takes the place of a shorter one, rows kept for each language.
BREAKS = b".,;:!?\n\x0b\x0c\r"
LONGEST, LEAST, ABSORBED, TOP = 4, 30, 80, 2000
#: Bits of the map of survivors (8 MB), and counters of a summary aimed at when the partitions are laid out.
MAP_BITS, COUNTERS = 1 << 26, 500_000
#: Names that a task holds before it hands them on, and bytes of text looked at at once.
HELD, SLICE = 2_000_000, 8_000_000
#: Most names in a row that is shuffled (4 kB of them).
PACK = 512

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(BREAKS))
_BREAK = b"\xff"  # in no UTF-8 text


def tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Word numbers of all texts end to end, -1 at breaks, and the words that they number."""
    raw = b"\n".join(texts).translate(_LOWER).replace(b"\n", b" \xff ")
    parts = pc.split_pattern(pa.array([raw], pa.large_binary()), pattern=b" ").flatten()
    coded = parts.filter(pc.greater(pc.binary_length(parts), 0)).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.index(coded.dictionary, pa.scalar(_BREAK, coded.dictionary.type)).as_py()
    if at >= 0:
        ids[ids == at] = -1
    return ids, coded.dictionary


def word_names(words: pa.Array, lang: str) -> np.ndarray:
    """A 64-bit name for each word in this language; the last one stands for a break."""
    seed = xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words)).tolist() + [0]


def phrase_names(names: np.ndarray, n: int) -> np.ndarray:
    """The name of the n words from each place on."""
    out = names.copy()
    for k in range(1, n):
        out = out[:-1]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + names[k:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


def marked(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which names the map of survivors holds."""
    place = names & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def places(ids: np.ndarray, names: np.ndarray, n: int, below: np.ndarray | None) -> np.ndarray:
    """Where phrases of n words start: no break inside, both parts of n - 1 words among the survivors."""
    end = len(ids) - n + 1
    if end <= 0:
        return np.zeros(0, np.int64)
    if n == 1:
        return np.flatnonzero(ids >= 0)
    whole = np.ones(end, bool)
    for k in range(n):
        whole &= ids[k : k + end] >= 0
    start = np.flatnonzero(whole)
    parts = phrase_names(names, n - 1)
    start = start[marked(below, parts[start])]
    return start[marked(below, parts[start + 1])]


def exact_counts(ids: np.ndarray, words: pa.Array, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
    """The different phrases of n words at these places, joined by a space, and how often each is there."""
    key, size = ids[at], len(words) + 1
    for k in range(1, n):
        _, key = np.unique(key * size + ids[at + k], return_inverse=True)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    columns = [words.take(pa.array(ids[at[first] + k])) for k in range(n)]
    return (pc.binary_join_element_wise(*columns, pa.scalar(b" ", words.type)) if n > 1 else columns[0]), count


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys added up."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


class Summary:
    """Misra-Gries counters. ``lost`` is the most that any key's counter lags behind its true count."""

    def __init__(self, room: int) -> None:
        self.room, self.lost = room, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.room, 1 << 16):
            self.merge()

    def merge(self) -> None:
        """Adds what waits to the counters; takes the first count without room off all of them."""
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        self.keys, self.counts = added(keys, counts)
        if len(self.keys) > self.room:
            off = int(np.partition(self.counts, len(self.counts) - self.room - 1)[len(self.counts) - self.room - 1])
            self.lost += off
            stay = self.counts > off
            self.keys, self.counts = self.keys[stay], self.counts[stay] - off

    def survivors(self, least: int) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.lost >= least]


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    for whole in batches:
        for batch in slices(whole, "t", SLICE):
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            groups: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts, strict=True):
                groups.setdefault(lang, []).append(text)
            yield from groups.items()


def scan(rows: DataFrame, n: int, below: Broadcast | None, exact_below: bool) -> DataFrame:
    """One reading of all texts: names and counts of phrases of n words (``name``, ``c``) and, if asked,
    the phrases of n - 1 words that the map ``below`` holds, with their counts (``lang``, ``phrase``, ``c``).
    Level 1 also yields the number of words of each language (phrase null, name null)."""
    wanted = n <= LONGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(below.value, np.uint8) if below is not None else None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, words_of, phrases = 0, {}, {}

        def out(lang, phrase, name, c):
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(name, pa.int64()), pa.array(c, pa.int64())], ["lang", "phrase", "name", "c"])

        def told():
            for lang, found in phrases.items():
                yield out([lang] * len(found), list(found), [None] * len(found), list(found.values()))

        for lang, texts in _by_lang(batches):
            ids, words = tokens(texts)
            if n == 1:
                words_of[lang] = words_of.get(lang, 0) + int((ids >= 0).sum())
            if not len(words):
                continue
            names = np.array(word_names(words, lang), np.uint64)[ids]
            if exact_below:
                at = places(ids, names, n - 1, None) if n == 2 else _whole(ids, n - 1)
                at = at[marked(bits, phrase_names(names, n - 1)[at])]
                found, count = exact_counts(ids, words, at, n - 1)
                known = phrases.setdefault(lang, {})
                for p, c in zip(found.cast(pa.large_string()).to_pylist(), count.tolist(), strict=True):
                    known[p] = known.get(p, 0) + c
                if sum(map(len, phrases.values())) > HELD // 8:
                    yield from told()
                    phrases.clear()
            if wanted:
                at = places(ids, names, n, bits)
                held.append(np.unique(phrase_names(names, n)[at], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [added(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out([None] * size, [None] * size, held[0][0].view(np.int64), held[0][1])
                        held, size = [], 0
        yield from told()
        if held:
            k, c = added(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            yield out([None] * len(k), [None] * len(k), k.view(np.int64), c)
        if words_of:
            yield out(list(words_of), [None] * len(words_of), [None] * len(words_of), list(words_of.values()))

    return rows.mapInArrow(run, "lang string, phrase string, name long, c long")


def _whole(ids: np.ndarray, n: int) -> np.ndarray:
    """Places from which n words follow without a break."""
    end = max(len(ids) - n + 1, 0)
    whole = np.ones(end, bool)
    for k in range(n):
        whole &= ids[k : k + end] >= 0
    return np.flatnonzero(whole)


def packed(counted: DataFrame) -> DataFrame:
    """``(part, names, counts)`` of ``counted(part, name, c)``: the numbers of a partition as bytes, many to a row,
    so that a shuffle carries little more than the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            part, names, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(part, kind="stable")
            part, names, counts = part[order], names[order], counts[order]
            begins = np.concatenate(([True], part[1:] != part[:-1]))
            nth = np.arange(len(part)) - np.maximum.accumulate(np.where(begins, np.arange(len(part)), 0))
            first = np.flatnonzero(nth % PACK == 0)
            ends = np.append(first[1:], len(part))
            bytes_of = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), bytes_of(names), bytes_of(counts)], ["part", "names", "counts"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy() for k in range(3)])
                size += batch.num_rows
            if size > HELD // 2:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return counted.select("part", "name", "c").mapInArrow(run, "part int, names binary, counts binary")


def frequent_names(counted: DataFrame, least: int, counters: int = COUNTERS) -> DataFrame:
    """Names that may reach ``least``: one Misra-Gries summary for each hash partition of ``counted(name, c)``.

    A partition has one counter more than its mass divided by ``least``. Partitions are so many that a
    summary has about ``counters`` of them; their masses (one number each) are known to the driver.
    """
    spark = counted.sparkSession
    mass = counted.agg(F.sum("c")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // (least * counters)))
    part = F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int")
    room = {r.part: r.mass // least + 1 for r in counted.groupBy(part.alias("part")).agg(F.sum("c").alias("mass")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries: dict[int, Summary] = {}
        for batch in batches:
            for p, names, counts in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                summaries.setdefault(p, Summary(room[p])).add(np.frombuffer(names, np.uint64), np.frombuffer(counts, np.int64))
        for s in summaries.values():
            yield pa.RecordBatch.from_arrays([pa.array(s.survivors(least).view(np.int64))], ["name"])

    return packed(counted.select(part.alias("part"), "name", "c")).repartition(parts, "part").mapInArrow(run, "name long")


def survivor_map(names: DataFrame) -> bytes:
    """The map of survivors, ``MAP_BITS`` bits whatever the input: at most 2,048 rows of 4 kB reach the driver."""
    place = F.col("name").bitwiseAND(MAP_BITS - 1)
    rows = names.groupBy(F.shiftright(place, 15).alias("b")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("m"))
    held = bytearray(MAP_BITS // 8)
    for r in rows.toLocalIterator():
        held[r.b * 4096 : r.b * 4096 + len(r.m)] = r.m
    return bytes(held)


def phrase_counts(docs: DataFrame, lang: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n_parts, f)`` of all phrases of 1 to 4 words with f >= least, and ``(lang, n)``."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("l"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    below, exact, sizes = None, [], None
    for n in range(1, LONGEST + 2):
        seen = staged(scan(rows, n, below, n > 1), "phrases")
        if n == 1:
            sizes = staged(seen.filter("lang IS NOT NULL").groupBy("lang").agg(F.sum("c").alias("n")), "sizes")
        else:
            totals = seen.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)
            exact.append(staged(totals.withColumn("n_parts", F.lit(n - 1)), "counts"))
            below.unpersist()
        if n <= LONGEST:
            below = spark.sparkContext.broadcast(survivor_map(frequent_names(seen.filter("name IS NOT NULL").select("name", "c"), least)))
        drop_staged(seen)
    counts = exact[0]
    for e in exact[1:]:
        counts = counts.union(e)
    return counts, sizes


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, absorbed: int = ABSORBED, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by the score of their weakest cut.

    ``(lang, rank, phrase, a, l, r, n, score)``: a, l, r are the counts of the phrase and of the two
    parts of its cut, n the words of the language. Products are decimals of 38 digits, so exact.
    """
    counts, sizes = phrase_counts(docs, lang, text, least)
    split = F.split("phrase", " ")
    cand = counts.filter("n_parts > 1").select("lang", "phrase", F.col("f").alias("a"), "n_parts", split.alias("w"))
    cuts = cand.select("lang", "phrase", "a", "w", "n_parts", F.explode(F.sequence(F.lit(1), F.col("n_parts") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n_parts") - F.col("k")), " ").alias("rest"))
    part = counts.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0))) div CAST(l + r AS DECIMAL(21,0))")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # parts of longer phrases
    inner = F.expr("flatten(transform(sequence(2, n_parts - 1), m -> transform(sequence(1, n_parts - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = cand.filter("n_parts > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    gone = F.expr(f"100 * CAST(b AS DECIMAL(20,0)) >= {absorbed} * CAST(a AS DECIMAL(20,0))")
    stay = weakest.join(longer, ["lang", "phrase"], "left").filter(F.col("b").isNull() | ~gone)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stay.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
