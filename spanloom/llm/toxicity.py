"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding writes letters that look alike (other scripts, full width, accents), digits and signs inside words
as the plain letters that they stand for; an ambiguous sign gives two spellings, which count once. The
lexicon holds stems and whole words that occur in far more toxic documents than others. A word counts with
the greatest weight of its entries, unless it stands in an exception phrase. The sum and the sum per word
go through a logistic curve, so long texts are not toxic for their length.

Lexicon, exception phrases and curve are fitted to at most ``SAMPLE`` labelled documents, those with the
smallest hash of their id; near copies count once. An entry must occur in a hundredth of the toxic ones, so
the lexicon is bounded by a hundred times the words of one document, and it is sent to all tasks.

Defined results: a null text is empty, and scores as any text without a hit; documents without an id are
not held out; an id that is labelled twice takes the greater label; repeated rows are scored one by one;
without toxic training documents every text gets the same low score. Other columns are passed through
untouched, whatever their names are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import at, drop_staged, plain, slices, staged, table

#: Labelled documents that are fitted to, lengths of stems, folds, and the fold that is held out.
SAMPLE, SHORTEST, LONGEST, FOLDS, HELD_OUT = 20_000, 3, 10, 5, 0
#: An entry occurs in this share of toxic documents and at least so often; its log odds exceed LEAST by
#: DEVIATIONS of their error. A longer stem must add GAIN. An exception is seen in so many clean documents.
SUPPORT, FEWEST, LEAST, DEVIATIONS, GAIN, EXCEPTION = 0.01, 3, math.log(4), 2.5, 0.3, 3

#: Letters of other scripts by the Latin letter that they look like.
LOOKALIKE = {
    "a": "аαɑ", "b": "вьβ", "c": "сϲ", "d": "ԁ", "e": "еєεҽ", "f": "ƒ", "g": "ɡ", "h": "һн", "i": "іıιɩ", "j": "јϳ", "k": "кκ", "l": "ӏⅼ",
    "m": "мμ", "n": "пηո", "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "гя", "s": "ѕʂ", "t": "тτ", "u": "υսц", "v": "νѵ", "w": "ԝωш", "x": "хχ", "y": "уγү", "z": "ᴢʐ",
}
#: Letters that digits and signs stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e"}
#: Phrases in which a word of this kind is harmless.
HARMLESS = ("trash can", "trash bin", "trash bag", "clown fish", "clown nose", "class clown", "pond scum", "idiot proof", "sore loser")

_ALIKE = {ord(c): latin for latin, found in LOOKALIKE.items() for c in found}
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SIGN = "".join(map(re.escape, SIGNS))
_INSIDE = re.compile(rf"[{_SIGN}]+(?=[^\W\d_])|(?<=[^\W\d_])\d\b")
_LETTERS = re.compile(r"[^\W\d_]+")


def spellings(word: str) -> str:
    """A lower-case word, and after a mark each way to read it in plain letters."""
    bare = _HIDDEN.sub("", word)
    if not bare.isascii():
        bare = "".join(c for c in unicodedata.normalize("NFKD", bare) if not unicodedata.combining(c)).translate(_ALIKE).lower()
    read = {bare}
    if _INSIDE.search(bare):
        for k in (0, -1):
            read.add(_INSIDE.sub(lambda m: "".join(SIGNS.get(c, c)[k] for c in m.group()), bare))
    read.discard(word)
    return "\x01".join([word, *sorted(read)])


def folded(text: str | None) -> tuple[str, int]:
    """The words of a text in lower case, single spaces between, with their other spellings; their number."""
    words = (text or "").lower().split()
    odd = {w: spellings(w) for w in set(words) if not w.isalpha() and (not w.isascii() or _INSIDE.search(w)) or not w.isascii()}
    return " ".join([odd.get(w, w) for w in words] if odd else words), len(words)


def stems(text: str) -> set[str]:
    """Beginnings of all words, and whole words (with a space at the end)."""
    found = set()
    for w in set(_LETTERS.findall(text)):
        found.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
        if len(w) >= SHORTEST:
            found.add(w + " ")
    return found


def origin(text: str) -> int:
    """The least hash of a text's three-word shingles: the same for most of its near copies."""
    words = text.split(" ")
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(len(words) - 2, 1))) >> 1


@dataclass
class Lexicon:
    entries: dict[str, float]
    exceptions: frozenset[str] = frozenset(HARMLESS)
    curve: tuple[float, float, float, float] = (-2.0, 0.0, 0.0, 0.0)
    automaton: object = field(default=None, compare=False)

    def __getstate__(self) -> tuple:
        return self.entries, self.exceptions, self.curve

    def __setstate__(self, state: tuple) -> None:
        self.entries, self.exceptions, self.curve = state
        self.automaton = None

    def hits(self, text: str) -> dict[int, float]:
        """Where the words of a folded text start that match, with their weights; exceptions included."""
        if not self.entries:
            return {}
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for e in self.entries:
                bare = e.rstrip(" ")
                whole, stem = self.entries.get(bare + " "), self.entries.get(bare)
                self.automaton.add_word(bare, (len(bare), whole, stem))
            self.automaton.make_automaton()
        found: dict[int, float] = {}
        for end, (size, whole, stem) in self.automaton.iter(text):
            start = end + 1 - size
            if start and text[start - 1].isalpha():
                continue
            weight = stem or 0.0
            if whole is not None and not text[end + 1 : end + 2].isalpha():
                weight = max(weight, whole)
            if weight:
                word = text.rfind(" ", 0, start) + 1
                found[word] = max(found.get(word, 0.0), weight)
        return found

    def phrases(self, text: str, word: int) -> list[str]:
        """The word that starts here with the one before and with the one after, in plain letters."""
        end = text.find(" ", word)
        end = len(text) if end < 0 else end
        after = text.find(" ", end + 1)
        near = [text[text.rfind(" ", 0, max(word - 1, 0)) + 1 : max(word - 1, 0)], text[word:end], text[end + 1 : len(text) if after < 0 else after]]
        letters = [" ".join(_LETTERS.findall(x.rsplit("\x01", 1)[-1])) for x in near]
        return [f"{a} {b}" for a, b in zip(letters, letters[1:], strict=False) if a and b]

    def measure(self, text: str, words: int) -> tuple[int, float]:
        """Number of hits outside exception phrases and their summed weight."""
        counted = [w for place, w in self.hits(text).items() if self.exceptions.isdisjoint(self.phrases(text, place))]
        return len(counted), sum(counted)

    def score(self, hits: int, weight: float, words: int) -> float:
        return float(1 / (1 + math.exp(-max(min(float(np.dot(self.curve, features(hits, weight, words))), 500.0), -500.0))))


def features(hits: int, weight: float, words: int) -> tuple[float, float, float, float]:
    return 1.0, float(hits > 0), math.log1p(weight), math.log1p(1000 * weight / (words + 20))


def chosen(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries and weights: the lower bound of the log odds ratio of occurring in a document."""
    odds = {}
    for e, a in toxic.items():
        b = clean.get(e, 0)
        low = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1)) - DEVIATIONS * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if low > LEAST:
            odds[e] = low
    kept: dict[str, float] = {}
    longer: dict[str, int] = {}
    for e in odds:
        if not e.endswith(" "):
            longer[e[:-1]] = max(longer.get(e[:-1], 0), toxic[e])
    for e in sorted(odds, key=lambda e: (len(e), e)):
        if longer.get(e, 0) >= 0.97 * toxic[e]:
            continue  # the longer stem says the same more exactly
        before = max((kept[e[:k]] for k in range(SHORTEST, len(e)) if e[:k] in kept), default=-math.inf)
        if odds[e] > before + GAIN:
            kept[e] = odds[e]
    return kept


def fitted_curve(rows: list[tuple[int, int, float, int]]) -> tuple[float, float, float, float]:
    """Logistic regression of (label, hits, weight, words) by Newton's method, slightly ridged."""
    y = np.array([r[0] for r in rows], float)
    x = np.array([features(*r[1:]) for r in rows], float).reshape(-1, 4)
    if not 0 < y.sum() < len(y):
        return math.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)), 0.0, 0.0, 0.0
    w, ridge = np.zeros(4), 0.01 * np.eye(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
    return tuple(w.tolist())


def fold(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def training_texts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> DataFrame:
    """``(toxic, folded, words)`` of the sampled training documents, one of each group of near copies."""
    known = labels.filter(F.col(label).isNotNull() & (fold(doc_id) != HELD_OUT)).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("toxic"))
    few = F.broadcast(staged(known.orderBy(F.xxhash64("id"), "id").limit(sample), "sample"))  # ``sample`` rows of two numbers
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(few, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                rows = [folded(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([origin(r[0]) for r in rows], pa.int64())], ["id", "toxic", "folded", "words", "origin"])

    made = staged(texts.select("id", "t", "toxic").mapInArrow(run, "id long, toxic int, folded string, words long, origin long"), "folded")
    return staged(made.groupBy("origin", "toxic").agg(F.min_by("folded", F.struct("id", "folded")).alias("folded"), F.min_by("words", F.struct("id", "folded")).alias("words")), "training")


def counted(rows: DataFrame, found) -> DataFrame:
    """In how many of the documents ``rows(toxic, folded)`` each of the strings occurs that ``found`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.update((s, toxic > 0) for s in found(text))
                if len(held) > 300_000:
                    yield _rows(held)
                    held = Counter()
        yield _rows(held)

    def _rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.bool_()), pa.array(list(held.values()), pa.int64())], ["s", "toxic", "c"])

    return rows.select("toxic", "folded").mapInArrow(run, "s string, toxic boolean, c long").groupBy("s").agg(F.sum(F.expr("IF(toxic, c, 0)")).alias("pos"), F.sum(F.expr("IF(toxic, 0, c)")).alias("neg"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Lexicon, exceptions and curve from the training folds of ``labels``."""
    rows = training_texts(docs, labels, doc_id, text, label, sample)
    total, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0))).first()
    n_clean = total - n_toxic
    support = max(FEWEST, math.ceil(SUPPORT * n_toxic))
    toxic = {r.s: r.pos for r in counted(rows.filter("toxic > 0"), stems).filter(F.col("pos") >= support).collect()}
    asked = docs.sparkSession.sparkContext.broadcast(frozenset(toxic))
    clean = {r.s: r.neg for r in counted(rows.filter("toxic <= 0"), lambda t: stems(t) & asked.value).collect()}
    lexicon = Lexicon(chosen(toxic, clean, n_toxic, n_clean))

    def near(t: str) -> set[str]:
        return {p for place in lexicon.hits(t) for p in lexicon.phrases(t, place)}

    rate = (F.col("neg") + 0.5) / (n_clean + 1) > (F.col("pos") + 0.5) / (n_toxic + 1)
    learnt = {r.s for r in counted(rows, near).filter((F.col("neg") >= EXCEPTION) & rate).collect()} if lexicon.entries else set()
    lexicon = Lexicon(lexicon.entries, frozenset(learnt) | frozenset(HARMLESS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, texts, words = (batch.column(i).to_pylist() for i in range(3))
            seen = [lexicon.measure(t, n) for t, n in zip(texts, words, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([int(y > 0) for y in toxic], pa.int32()), pa.array([h for h, _ in seen], pa.int64()), pa.array([w for _, w in seen], pa.float64()), batch.column(2)], ["toxic", "hits", "weight", "words"])

    seen = rows.select("toxic", "folded", "words").mapInArrow(run, "toxic int, hits long, weight double, words long")
    curve = fitted_curve(sorted(tuple(r) for r in seen.collect()))  # ``sample`` rows of four numbers at most
    drop_staged(rows)
    return Lexicon(lexicon.entries, lexicon.exceptions, curve)


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` with ``n_hits`` and ``score`` after their columns; no shuffle."""
    rows = plain(docs)
    width, place = len(docs.columns), int(at(docs, text)[1:])
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for whole in batches:
            for batch in slices(whole, f"c{place}"):
                hits, scores = [], []
                for t in batch.column(place).to_pylist():
                    plain_text, words = folded(t)
                    n, weight = known.measure(plain_text, words)
                    hits.append(n)
                    scores.append(known.score(n, weight, words))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.int64()), pa.array(scores, pa.float64())], [*(f"c{i}" for i in range(width)), "n_hits", "score"])

    return rows.mapInArrow(run, f"{kinds}, n_hits long, score double").toDF(*docs.columns, "n_hits", "score")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs, lexicon)
    return out.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")
