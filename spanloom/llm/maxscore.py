"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are cut into blocks, blocks into chunks. The index holds, for each block, the postings with
their impacts, the greatest impact of every term in every chunk, and for pairs of terms that are asked for
together the list of chunks where some document holds both, with the greatest joint impact there. A
document holds both terms, or its share is at most the greater one's, so for a pair

    bound = max(joint impact, impact of one, impact of the other) <= sum of the two impacts.

A query pairs its terms so that the bounds save most. Chunks whose bound is below the k-th score known so
far are skipped; in the others terms are added from the greatest impact on, until the rest's bound shows
that only documents met so far can still get in, and of these the hopeless ones are dropped after each
further term. A first round over a few blocks gives every query a k-th score to begin with; it never
changes a result.

Defined results: a null text has no terms; repeated rows are documents of their own; rows without an id
count and rank after all others of the same score; queries without terms have no rows; queries repeated
with id and text are one. Only the columns that are named come in, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import drop_staged, slices, staged, table, text_bytes

TOP = 20
#: Documents of a block, documents of a chunk, blocks of the first round.
BLOCK, CHUNK, FIRST = 8192, 128, 4
CHUNKS = BLOCK // CHUNK
#: Terms of a query, ordered by weight, are paired with so many that follow.
SPAN = 2
#: Queries are searched in groups of about so many terms, which bounds what every task is sent.
MOST_TERMS = 400_000
#: Fixed values of the score.
SCALE, B_PERCENT, K_TEN = 1_000_000_000, 25, 12

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 128 or c in _LETTERS else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters; only A-Z are lower-cased."""
    return raw.translate(_FOLD).split()


@dataclass
class Queries:
    """A group of queries over a vocabulary of their own."""

    ids: list
    terms: list[list[tuple[int, int]]]  # (term, times), from the greatest weight on once ``order`` ran
    vocabulary: dict[bytes, int]

    def order(self, weight: np.ndarray) -> None:
        self.terms = [sorted(t, key=lambda x: (-weight[x[0]], x[0])) for t in self.terms]

    def pairs(self) -> dict[int, list[int]]:
        """Partners of each term that come after it in some query."""
        found: dict[int, set[int]] = {}
        for held in self.terms:
            for i, (a, _) in enumerate(held):
                for b, _ in held[i + 1 : i + 1 + SPAN]:
                    found.setdefault(min(a, b), set()).add(max(a, b))
        return {a: sorted(bs) for a, bs in found.items()}


def query_group(rows: list[tuple]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    held = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms((text or "").encode())) for _, text in rows]
    return Queries([i for i, _ in rows], [sorted(h.items()) for h in held], vocabulary)


def forward(docs: DataFrame, doc_id: str, text: str, queries) -> DataFrame:
    """``(id, n, terms, times)``: of each document with terms their number, and those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = queries.value.vocabulary.get
        for whole in batches:
            for batch in slices(whole, "text", 8_000_000):
                rows, sizes, found, times, ends = [], [], [], [], [0]
                for i, raw in enumerate(text_bytes(batch.column(1))):
                    words = terms(raw)
                    if not words:
                        continue
                    held = Counter(map(known, words))
                    held.pop(None, None)
                    rows.append(i)
                    sizes.append(len(words))
                    found.extend(held.keys())
                    times.extend(held.values())
                    ends.append(len(found))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (found, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "times"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, terms array<int>, times array<int>")


def chunk_maxima(docs: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of sorted documents and the greatest impact in each."""
    chunk = docs // CHUNK
    first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
    return chunk[first], np.maximum.reduceat(impact, first)


INDEX = "ids array<long>, terms array<int>, ends array<int>, docs array<int>, impacts array<long>, pair_a array<int>, pair_b array<int>, pair_ends array<int>, pair_chunks array<int>, pair_impacts array<long>"


def block_row(ids: pa.Array, n: np.ndarray, count: np.ndarray, term: np.ndarray, times: np.ndarray, weight: np.ndarray, partners: dict[int, list[int]], docs_all: int, terms_all: int) -> pa.RecordBatch:
    """The index of one block as one row."""
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), count)
    m = 100 - B_PERCENT + (B_PERCENT * n * docs_all) // max(terms_all, 1)
    impact = weight[term] * ((SCALE * times) // (1000 * times + K_TEN * m[doc]))
    order = np.argsort(term, kind="stable")
    term, doc, impact = term[order], doc[order], impact[order]
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    held, ends = term[first], np.append(first, len(term))
    place = {t: i for i, t in enumerate(held.tolist())}
    dense = np.zeros(BLOCK, np.int64)
    pair_a, pair_b, pair_ends, chunks, joint = [], [], [0], [], []
    size = 0
    for a, i in place.items():
        mine = slice(ends[i], ends[i + 1])
        near = [(b, place[b]) for b in partners.get(a, ()) if b in place]
        if not near:
            continue
        dense[doc[mine]] = impact[mine]
        for b, j in near:
            d = doc[ends[j] : ends[j + 1]]
            other = dense[d]
            both = np.flatnonzero(other)
            if len(both):
                c, x = chunk_maxima(d[both], other[both] + impact[ends[j] : ends[j + 1]][both])
                chunks.append(c)
                joint.append(x)
                size += len(c)
            pair_a.append(a)
            pair_b.append(b)
            pair_ends.append(size)
        dense[doc[mine]] = 0
    gather = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    columns = [(held, pa.int32()), (ends, pa.int32()), (doc, pa.int32()), (impact, pa.int64()), (pair_a, pa.int32()), (pair_b, pa.int32()), (pair_ends, pa.int32()), (gather(chunks), pa.int32()), (gather(joint), pa.int64())]
    arrays = [ids, *(pa.array(np.asarray(x)).cast(kind) for x, kind in columns)]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
    return pa.RecordBatch.from_arrays(lists, [f.split()[0] for f in INDEX.split(", ")])


def built(rows: DataFrame, queries, weight, docs_all: int, terms_all: int) -> DataFrame:
    """One index row for each block of documents of ``forward``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partners = queries.value.pairs()
        waiting: list[pa.RecordBatch] = []

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, n, term, times = (t.column(i).chunk(0) for i in range(4))
            count = np.diff(term.offsets.to_numpy())
            flat = [x.flatten().to_numpy().astype(np.int64) for x in (term, times)]
            return block_row(ids, n.to_numpy(), count, *flat, weight.value, partners, docs_all, terms_all)

        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK - size)
                waiting.append(part)
                at += part.num_rows
                size += part.num_rows
                if size == BLOCK:
                    yield block(waiting)
                    waiting, size = [], 0
        if size:
            yield block(waiting)

    return rows.mapInArrow(run, INDEX)


class Block:
    """An index row, ready to be searched."""

    def __init__(self, row: dict) -> None:
        get = lambda name: row[name].to_numpy(zero_copy_only=False)
        self.ids, self.no_id = row["ids"].fill_null(0).to_numpy(), row["ids"].is_null().to_numpy(zero_copy_only=False)
        ends, docs, impacts = get("ends"), get("docs"), get("impacts")
        self.lists = {t: (docs[ends[i] : ends[i + 1]], impacts[ends[i] : ends[i + 1]]) for i, t in enumerate(get("terms").tolist())}
        ends, chunks, joint = get("pair_ends"), get("pair_chunks"), get("pair_impacts")
        self.pairs = {(a, b): (chunks[ends[i] : ends[i + 1]], joint[ends[i] : ends[i + 1]]) for i, (a, b) in enumerate(zip(get("pair_a").tolist(), get("pair_b").tolist(), strict=True))}
        self.maxima: dict[int, np.ndarray] = {}

    def most(self, term: int) -> np.ndarray:
        """The greatest impact of a term in each chunk."""
        if term not in self.maxima:
            self.maxima[term] = np.zeros(CHUNKS, np.int64)
            chunk, x = chunk_maxima(*self.lists[term])
            self.maxima[term][chunk] = x
        return self.maxima[term]

    def saving(self, a: tuple[int, int], b: tuple[int, int], top_a: np.ndarray, top_b: np.ndarray) -> np.ndarray:
        """By how much the bound of a pair is below the sum of both bounds, in each chunk."""
        joint = np.zeros(CHUNKS, np.int64)
        chunk, x = self.pairs[min(a[0], b[0]), max(a[0], b[0])]
        times = min(a[1], b[1])
        joint[chunk] = times * x + (a[1] - times) * (top_a[chunk] // a[1]) + (b[1] - times) * (top_b[chunk] // b[1])
        return np.maximum(top_a + top_b - np.maximum(np.maximum(top_a, top_b), joint), 0)

    def search(self, query: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places in the block) with a score of at least ``least``, and more than 0; their scores."""
        held = [(t, q) for t, q in query if t in self.lists]
        none = np.zeros(0, np.int64)
        if not held:
            return none, none
        tops = [q * self.most(t) for t, q in held]
        # pair the terms, most saved first
        found = [(s.sum(), i, j, s) for i in range(len(held)) for j in range(i + 1, min(i + 1 + SPAN, len(held))) if (min(held[i][0], held[j][0]), max(held[i][0], held[j][0])) in self.pairs for s in [self.saving(held[i], held[j], tops[i], tops[j])]]
        free, matched = set(range(len(held))), []
        for total, i, j, s in sorted(found, key=lambda x: -x[0]):
            if total > 0 and i in free and j in free:
                free -= {i, j}
                matched.append((i, j, s))
        order = sorted(range(len(held)), key=lambda i: -int(tops[i].max()))
        turn = {i: k for k, i in enumerate(order)}
        rest = np.zeros((len(held) + 1, CHUNKS), np.int64)  # bound of the terms from the k-th on
        for k, i in enumerate(order):
            rest[: k + 1] += tops[i]
        for i, j, s in matched:
            rest[: min(turn[i], turn[j]) + 1] -= s
        least = max(least, 1)
        live = rest[0] >= least
        if not live.any():
            return none, none
        score = np.zeros(BLOCK, np.int64)
        kept = None
        for k, i in enumerate(order):
            docs, impact = self.lists[held[i][0]]
            if kept is None:
                score[docs] += held[i][1] * impact
                if int(rest[k + 1].max()) < least:  # a document without any term so far cannot get in
                    kept = np.flatnonzero(live[np.arange(BLOCK) // CHUNK] & (score + np.repeat(rest[k + 1], CHUNK) >= least))
            else:
                at = np.minimum(np.searchsorted(docs, kept), len(docs) - 1)
                score[kept] += np.where(docs[at] == kept, held[i][1] * impact[at], 0)
                kept = kept[score[kept] + rest[k + 1][kept // CHUNK] >= least]
            if kept is not None and not len(kept):
                return none, none
        return kept, score[kept]


def best(ids: np.ndarray, no_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: by score, then id, rows without an id last."""
    return np.lexsort((ids, no_id, -score))[:k]


def searched(index: DataFrame, queries, least: dict[int, int], k: int) -> DataFrame:
    """``(query, id, score)``: the k best of each query in every task; query is its place in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value.terms
        top: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({name: batch.column(name)[i].values for name in batch.schema.names})
                for q, query in enumerate(asked):
                    mine = top.get(q)
                    floor = least.get(q, 0) if mine is None or len(mine[2]) < k else max(least.get(q, 0), int(mine[2][-1]))
                    docs, score = block.search(query, floor)
                    if not len(docs):
                        continue
                    new = block.ids[docs], block.no_id[docs], score
                    if mine is not None:
                        new = tuple(np.concatenate(x) for x in zip(mine, new, strict=True))
                    chosen = best(*new, k)
                    top[q] = tuple(x[chosen] for x in new)
        for q, (ids, no_id, score) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, pa.int64(), mask=no_id), pa.array(score)], ["query", "id", "score"])

    return index.mapInArrow(run, "query int, id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_group(docs: DataFrame, doc_id: str, text: str, group: Queries, k: int) -> DataFrame:
    """The k best documents of every query of a group: ``(query, rank, id, score)``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(group)
    rows = staged(forward(docs, doc_id, text, sent), "forward")
    docs_all, terms_all = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(group.vocabulary), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the vocabulary at most
        df[r.t] = r["count"]
    weight = np.floor(1000 * np.log((2 * docs_all + 2) / (2 * df + 1))).astype(np.int64)
    group.order(weight)
    sent = spark.sparkContext.broadcast(group)
    index = staged(built(rows, sent, spark.sparkContext.broadcast(weight), docs_all, terms_all), "index")
    drop_staged(rows)
    first = ranked(searched(index.limit(FIRST), sent, {}, k), k).filter(F.col("rank") == k)
    found = staged(ranked(searched(index, sent, {r.query: r.score for r in first.collect()}, k), k), "found")
    drop_staged(index)
    return found


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the k best documents with a score above 0 for each item.

    Items are taken in groups of about ``most_terms`` terms, each with an index of its own, so what a
    task holds does not grow with their number.
    """
    spark = docs.sparkSession
    asked = staged(items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).distinct(), "items")
    letters = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    groups = 1 + letters // (4 * most_terms)
    out = None
    for g in range(groups):
        rows = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g) if groups > 1 else asked
        group = query_group([(r.item, r.text) for r in rows.collect()])
        found = search_group(docs, doc_id, text, group, k)
        names = spark.createDataFrame(list(enumerate(group.ids)), f"query int, item {asked.schema['item'].dataType.simpleString()}")
        part = found.join(names, "query").select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
        out = part if out is None else out.union(part)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
