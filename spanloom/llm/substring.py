"""Removal of repeated 20-word passages by recompression.

Each round of recompression splits the symbols in two classes by their names and joins every
adjacent left-right pair into one symbol, named by a hash of its parts. Names are the same wherever
the same words stand, so no table of names is needed, and whether two neighbours join depends on
these two alone: a repeated passage has the same symbols inside, but for at most one symbol at
either end in each round. Runs of one symbol never join, which keeps that bound.

* After two rounds a symbol has at most four words. A 20-word window chooses the smallest pair of
  symbols that lies surely inside; equal windows choose equal pairs. A first Spark round names these
  pairs over the whole corpus; a pair that stands only once rules out all its windows.
* In what is left, pairs of high symbols name passages: first after fourteen rounds, then, where these
  settled nothing, after eleven, nine and seven. A second Spark round tells which of the names stand
  earlier too; all windows in such a passage go at once. The words of a passage verify its name by
  96 bits of another hash.
* Only the windows that are left, at the edges of passages and in their first places, are compared by
  such a hash of their words in a third round.

Tasks settle what they see twice themselves, so of one passage no more rows are shuffled than there
are tasks, however often it occurs. Nothing but rows keyed by hashes or by documents is shuffled.

Defined results: a null text has no words; repeated rows (same id, same text) are one document and
all returned; different texts under one id are told apart and ordered by a hash of the text; null
ids come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import slices, staged, table, text_bytes

WINDOW = 20
FINE_ROUNDS, COARSE_ROUNDS, MIDDLE_ROUNDS = 2, 14, (7, 9, 11)
#: A pair of symbols may start this far from either end of a window and is surely inside it.
EDGE = 3
#: Rows that a task settles among themselves at once.
HELD = 2_000_000

U = np.uint64
BASES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
LAST = U(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the pair of symbols a, b."""
    return mix(a * U(0xD6E8FEB86659FD93) + mix(b))


class Words:
    """The words of some documents in one row of 128-bit names."""

    def __init__(self, texts: list[bytes]):
        lists = [t.split() for t in texts]
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        digest = xxhash.xxh3_128_digest
        names = np.frombuffer(b"".join([digest(w) for x in lists for w in x]), np.uint64).reshape(-1, 2)
        self.names = np.ascontiguousarray(names[:, 0])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.total = len(self.names)
        self.power, self.prefix = [], []
        for base, column in zip(BASES, (self.names, names[:, 1]), strict=True):
            inverse = U(pow(int(base), -1, 1 << 64))
            up = np.full(self.total + 1, base)
            down = np.full(self.total + 1, inverse)
            up[:1] = down[:1] = 1
            self.power.append(np.multiply.accumulate(up))
            self.prefix.append(np.r_[U(0), np.cumsum(column * np.multiply.accumulate(down)[: self.total], dtype=np.uint64)])

    def hashes(self, start: np.ndarray, width: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits for the words [start, start + width), the same wherever they stand."""
        spread = np.asarray(width, np.uint64)
        one, two = (mix((p[start + width] - p[start]) * w[start] + spread) for p, w in zip(self.prefix, self.power, strict=True))
        return one.view(np.int64), (two >> U(32)).astype(np.int64)

    def symbols(self, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and names of the symbols after so many rounds."""
        return self.levels((rounds,))[0]

    def levels(self, wanted: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and names of the symbols after each of some numbers of rounds, fewest first."""
        start, name = np.arange(self.total), self.names
        out = []
        for r in range(max(wanted)):
            right = (mix(name + U(r + 1)) >> U(63)).astype(bool)
            doc = self.doc[start]
            join = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
            head = np.flatnonzero(np.r_[True, ~join]) if self.total else start
            joined = np.r_[join, False][head] if self.total else join
            fresh = name[head]
            at = head[joined]
            fresh[joined] = both(name[at], name[at + 1])
            start, name = start[head], fresh
            if r + 1 in wanted:
                out.append((start, name))
        return out

    def windows(self) -> np.ndarray:
        """Whether a whole window starts at each word."""
        ok = np.zeros(self.total, bool)
        if self.total >= WINDOW:
            ok[: self.total - WINDOW + 1] = self.doc[: self.total - WINDOW + 1] == self.doc[WINDOW - 1 :]
        return ok


def _least(value: np.ndarray, reach: int) -> np.ndarray:
    """Smallest value at each place and the ``reach - 1`` places after it."""
    done, out = 1, value
    while done < reach:
        step = min(done, reach - done)
        out = np.minimum(out, np.r_[out[step:], np.full(min(step, len(out)), LAST)])
        done += step
    return out


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first windows and numbers of windows of each run of windows that choose the same pair,
    and whether the run met its pair in two places (periodic words)."""
    ok = words.windows()
    if not ok.any():
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    start, name = words.symbols(FINE_ROUNDS)
    key = both(name[:-1], name[1:])
    end = np.r_[start[2:], words.total]
    width = end - start[:-1]
    best, value_at = np.full(words.total, LAST), np.full(words.total + 14, LAST)
    value_at[start[:-1]] = key
    # pairs of up to four words fit wherever they start in [3, 13], wider ones only in [3, 9]
    for narrow, reach in ((True, 11), (False, 7)):
        value = np.full(words.total, LAST)
        of = (width <= 4) == narrow
        value[start[:-1][of]] = key[of]
        best = np.minimum(best, np.r_[_least(value, reach)[EDGE:], np.full(EDGE, LAST)])
    at = np.flatnonzero(ok)
    chosen = best[at]
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1) | (words.doc[at[1:]] != words.doc[at[:-1]])]
    first = np.flatnonzero(new)
    places = sum((value_at[at + k] == chosen).astype(np.int8) for k in range(EDGE, 15))
    twice = np.maximum.reduceat(places, first) > 1
    return chosen[first].view(np.int64), at[first], np.diff(np.r_[first, len(at)]), twice


def passages(words: Words, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and widths of the pairs of symbols that hold a window."""
    if len(start) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.r_[start[2:], words.total]
    width = end - start[:-1]
    ok = (words.doc[start[:-1]] == words.doc[end - 1]) & (width >= WINDOW)
    return start[:-1][ok], width[ok]


def first_and_later(h1, h2, doc, at) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come first of their hash, and rows with another place before them."""
    order = np.lexsort((at, doc, h2, h1))
    a, b, d, p = h1[order], h2[order], doc[order], at[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(order) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    later = (d != d[lead]) | (p != p[lead])
    return order[new], order[later]


#: Rows between the rounds. check: second half of a hash, null for a choice of windows.
ROWS = "check long, doc long, key long, at long, width long, sure boolean"
NAMES = ["check", "doc", "key", "at", "width", "sure"]


def _rows(check, doc, key, at, width, sure) -> pa.RecordBatch:
    n = len(doc)
    check = pa.nulls(n, pa.int64()) if check is None else pa.array(check)
    return pa.RecordBatch.from_arrays([check, pa.array(doc), pa.array(key), pa.array(at), pa.array(width), pa.array(np.full(n, sure))], NAMES)


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) * BASES[0] + at.astype(np.uint64)).view(np.int64)


def _settle(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Of long passages or windows: what this task saw before is sure, the rest is asked for."""
    if held:
        h1, h2, doc, at, width = (np.concatenate(x) for x in zip(*held, strict=True))
        first, later = first_and_later(h1, h2, doc, at)
        yield _rows(h2[first], doc[first], h1[first], at[first], width[first], False)
        yield _rows(h2[later], doc[later], _spread(doc[later], at[later]), at[later], width[later], True)


def _settle_choices(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Of choices of windows: those of a key that this task saw twice are sure; one row asks for others."""
    if held:
        key, doc, at, width, twice = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        same = np.zeros(len(s), bool)
        if len(s):
            same[1:] |= ~new[1:]
            same[:-1] |= ~new[1:]
        ask, sure = order[new], order[same & ~new]
        # the asking row of a key seen twice counts as two, by a negative width
        twice = same[new] | twice[ask]
        yield _rows(None, doc[ask], key[ask], at[ask], np.where(twice, -width[ask], width[ask]), False)
        yield _rows(None, doc[sure], _spread(doc[sure], at[sure]), at[sure], width[sure], True)


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First round, over ``(doc, text)``: choices of windows and long passages."""
    choices, long, count = [], [], 0
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(text_bytes(batch.column(1)))
            if not words.total:
                continue
            ids = batch.column(0).to_numpy()
            key, at, width, twice = anchors(words)
            choices.append([key, ids[words.doc[at]], at - words.starts[words.doc[at]], width, twice])
            start, span = passages(words, words.symbols(COARSE_ROUNDS)[0])
            long.append([*words.hashes(start, span), ids[words.doc[start]], start - words.starts[words.doc[start]], span])
            count += len(key)
            if count > HELD:
                yield from _settle_choices(choices)
                yield from _settle(long)
                choices, long, count = [], [], 0
    yield from _settle_choices(choices)
    yield from _settle(long)


def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a key are here. Out: ``(doc, at, width, seen)``; seen: the words were there before
    (windows at .. at + width - 1, or the passage), else these windows have to be compared."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    choice = t.column("check").is_null().to_numpy(zero_copy_only=False)
    check = t.column("check").fill_null(0).to_numpy()
    doc, key, at, width, sure = (t.column(c).to_numpy() for c in NAMES[1:])
    out = [(np.flatnonzero(sure & choice), False), (np.flatnonzero(sure & ~choice), True)]
    ask = np.flatnonzero(~sure & choice)
    _, inverse = np.unique(key[ask], return_inverse=True)
    times = np.bincount(inverse, np.where(width[ask] < 0, 2, 1)) if len(ask) else np.zeros(0)
    out.append((ask[times[inverse] > 1], False))
    ask = np.flatnonzero(~sure & ~choice)
    out.append((ask[first_and_later(key[ask], check[ask], doc[ask], at[ask])[1]], True))
    for rows, seen in out:
        yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(at[rows]), pa.array(np.abs(width[rows])), pa.array(np.full(len(rows), seen))], ["doc", "at", "width", "seen"])


def _spans(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    value = column[row].values if column[row].is_valid else None
    if value is None or not len(value):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return value.field(0).to_numpy(), value.field(1).to_numpy()


def _covered(at: np.ndarray, width: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge)[:n] > 0


def _open(words: Words, batch: pa.RecordBatch, known: tuple[int, ...], todo: int) -> np.ndarray:
    """Which words of a batch start a window that the rounds so far have left open."""
    out = np.zeros(words.total, bool)
    for row in range(batch.num_rows):
        n, at = int(words.sizes[row]), int(words.starts[row])
        wanted = _covered(*_spans(batch.column(todo), row), n)
        for column in known:
            start, width = _spans(batch.column(column), row)
            if len(start):
                wanted &= ~_covered(start, width - WINDOW + 1, n)
        out[at : at + n] = wanted
    return out


def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second round, over ``(doc, text, known, todo)``: passages of open windows by pairs of high symbols,
    the highest first and lower ones where those leave a window out."""
    held, count = [], 0
    for whole in batches:
        whole = whole.filter(whole.column(3).is_valid())
        for batch in slices(whole, "text") if whole.num_rows else ():
            words = Words(text_bytes(batch.column(1)))
            ids = batch.column(0).to_numpy()
            left = _open(words, batch, (2,), 3)
            sums, taken = np.r_[0, np.cumsum(left)], np.zeros(words.total, bool)
            for start, _ in words.levels(MIDDLE_ROUNDS)[::-1] if left.any() else ():
                at, width = passages(words, start)
                windows = width - WINDOW + 1
                fresh = np.r_[0, np.cumsum(left & ~taken)]
                good = (sums[at + windows] - sums[at] == windows) & (fresh[at + windows] > fresh[at])
                at, width = at[good], width[good]
                taken |= _covered(at, width - WINDOW + 1, words.total)
                doc = words.doc[at]
                held.append([*words.hashes(at, width), ids[doc], at - words.starts[doc], width])
                count += len(at)
            if count > HELD:
                yield from _settle(held)
                held, count = [], 0
    yield from _settle(held)


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Third round, over ``(doc, text, known, todo, more)``: hashes of the windows that are still open."""
    held, count = [], 0
    for whole in batches:
        whole = whole.filter(whole.column(3).is_valid())
        for batch in slices(whole, "text") if whole.num_rows else ():
            words = Words(text_bytes(batch.column(1)))
            ids = batch.column(0).to_numpy()
            at = np.flatnonzero(_open(words, batch, (2, 4), 3))
            doc = words.doc[at]
            held.append([*words.hashes(at, WINDOW), ids[doc], at - words.starts[doc], np.full(len(at), WINDOW)])
            count += len(at)
            if count > HELD:
                yield from _settle(held)
                held, count = [], 0
    yield from _settle(held)


def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last pass, over ``(doc, text, known, more, edges)``: what is left of each document."""
    for whole in batches:
        for batch in slices(whole, "text", 8_000_000):
            rows = []
            for row, raw in enumerate(text_bytes(batch.column(1))):
                words = raw.split()
                n, gone = len(words), 0
                spans = [_spans(batch.column(c), row) for c in (2, 3, 4)]
                at, width = (np.concatenate(x) for x in zip(*spans, strict=True))
                if len(at):
                    cut = _covered(at, width, n)
                    gone = int(cut.sum())
                    words = [w for w, c in zip(words, cut.tolist(), strict=True) if not c]
                rows.append((n, gone, b" ".join(words)))
            n, gone, text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.binary())], ["doc", "n_words", "n_removed", "kept"])


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(doc, text)`` where the number ``doc`` orders documents, and the ids of the numbers.

    The id itself serves (no second table) unless ids are null or stand more than once.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.select(F.col("doc_id").alias("doc"), "text"), None
    marked = docs.withColumn("mark", F.xxhash64("text"))
    ordered = marked.select("doc_id", "mark").distinct().orderBy(F.col("doc_id").asc_nulls_first(), "mark")
    numbers = staged(ordered.withColumn("doc", F.monotonically_increasing_id()), "numbers")
    joined = marked.join(numbers, marked.doc_id.eqNullSafe(numbers.doc_id) & (marked.mark == numbers.mark), "left")
    return joined.select("doc", "text"), numbers.select("doc", "doc_id")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row; kept is the UTF-8 of what is left."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base, ids = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    shown = "doc long, at long, width long, seen boolean"
    first = base.mapInArrow(scan, ROWS).repartition(n, "key").mapInArrow(decide, shown)
    span = F.struct("at", "width")
    known, todo = F.collect_list(F.when(F.col("seen"), span)), F.collect_list(F.when(~F.col("seen"), span))
    spans = staged(first.groupBy(F.col("doc").alias("d")).agg(known.alias("known"), todo.alias("todo")), "spans")
    # all joins read the same shuffle of the texts
    todo = F.when(F.size("todo") > 0, F.col("todo")).alias("todo")
    with_spans = base.join(spans, base.doc == spans.d, "left")

    def seen(asked: DataFrame, name: str) -> DataFrame:
        found = asked.repartition(n, "key").mapInArrow(decide, shown).filter("seen")
        return found.groupBy(F.col("doc").alias(name[0])).agg(F.collect_list(span).alias(name))

    more = seen(with_spans.select("doc", "text", "known", todo).mapInArrow(reveal, ROWS), "more")
    with_more = with_spans.join(more, base.doc == F.col("m"), "left")
    edges = seen(with_more.select("doc", "text", "known", todo, "more").mapInArrow(compare, ROWS), "edges")
    last = with_more.join(edges, base.doc == F.col("e"), "left")
    left = last.select("doc", "text", "known", "more", "edges").mapInArrow(strip, "doc long, n_words long, n_removed long, kept binary")
    if ids is None:
        return left.withColumnRenamed("doc", "doc_id")
    return left.join(ids, "doc").select("doc_id", "n_words", "n_removed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
