"""Exact token counts of a byte-level BPE with word ends, at every prefix.

A text is cut into pre-tokens as the tokenizer does. The prefix dynamic program of ``bpe`` finds the
token count of every prefix of every distinct pre-token once and keeps them. Laid end to end, each
above the total of those before it, they are the token counts of all prefixes of the text; from these
come its count, the count of any part cut off, and the longest prefix within any budget, and nothing
is encoded again.

Prefixes end at characters of the normalised text without the white space between pre-tokens; none
ends inside an added special token.

Defined results: a null text counts as empty (0 tokens, fits); repeated rows are counted one by
one; strings of added special tokens inside a text are one token each, as is the library's default;
only the five columns it states come out, so other columns cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.bpe import Automaton, PrefixEncoder, merge
from spanloom.llm.common import slices, table

LIMIT = 2048
END = "</w>"
#: Distinct pre-tokens whose counts a worker remembers, and a count that fits no budget.
REMEMBERED, NEVER = 400_000, 2**31
#: Texts of these characters only are cut by the pattern alone; all others by the library's own steps.
SIMPLE = regex.compile(r"[\t\n\r\x20-\x7eÀ-ɏ]*")


def byte_names() -> dict[int, str]:
    """The printable stand-in of each byte, as byte-level vocabularies write it."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordCounter:
    """Token counts by one tokenizer file with a ``Split`` pattern and an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("end_of_word_suffix") != END:
            raise ValueError("a BPE with word ends is needed")
        self.library = Tokenizer.from_file(path)
        self.names = byte_names()
        self.bytes = {name: b for b, name in self.names.items()}
        ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        tokens = [""] * (max(spec["model"]["vocab"].values()) + 1)
        pieces = []
        for token, number in spec["model"]["vocab"].items():
            tokens[number] = token
            last = token.endswith(END)
            pieces.append(([self.bytes[c] for c in (token[: -len(END)] if last else token)], number, last))

        def compatible(a: int, b: int) -> bool:
            parts = [tokens[a], tokens[b]] if a >= 0 else [tokens[b]]
            text = "".join(parts)
            last = text.endswith(END)
            symbols = list(text[: -len(END)] if last else text)
            if last:
                symbols[-1] += END
            return merge(symbols, lambda x, y: ranks.get((x, y))) == parts

        self.encoder = PrefixEncoder(Automaton(pieces, 256), compatible)
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.specials = set(special)
        #: Of each pre-token the counts of its prefixes, as little-endian 32-bit numbers.
        self.known: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = {s: np.array([NEVER] * (len(s) - 1) + [1], np.uint32).tobytes() for s in self.specials}
        self.totals = dict.fromkeys(self.specials, 1)

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's string is one of its own."""
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in ([p] if p in self.specials else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if SIMPLE.fullmatch(text):
            return self.pattern.findall(text.lower())
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.bytes[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in shown]

    def learn(self, words: set[str]) -> None:
        """Remember the counts of all prefixes of these pre-tokens."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [w for w in words if w not in self.known]
        self._learn(new)
        # a pre-token of several sorts of characters may be cut otherwise where it ends early
        for w in new:
            if len(w) > 1 and w[0].isalpha() != w[-1].isalpha():
                parts = [self.pattern.findall(w[: k + 1]) for k in range(len(w))]
                self._learn([x for p in parts for x in p if x not in self.known])
                self.known[w] = np.array([sum(self.count(x) for x in p) for p in parts], np.uint32).tobytes()

    def _learn(self, new: list[str]) -> None:
        raw = [np.frombuffer(w.encode("utf-8", "surrogateescape"), np.uint8) for w in new]
        for part, sizes, _, _, counts in self.encoder.many(raw, True):
            by_word = np.ascontiguousarray(counts[1:].T.astype(np.uint32))
            for row, (k, size) in enumerate(zip(part.tolist(), sizes.tolist(), strict=True)):
                own, word = by_word[row, :size], new[k]
                if len(word) < size:  # only where a character ends
                    own = own[np.r_[(raw[k][1:] & 0xC0) != 0x80, True]]
                self.known[word] = own.tobytes()
                self.totals[word] = int(own[-1])

    def count(self, word: str) -> int:
        return self.totals[word]

    def prefixes(self, words: list[str]) -> np.ndarray:
        """Token counts of the text of these pre-tokens at each of its characters; all must be known."""
        each = list(map(self.known.__getitem__, words))
        flat = np.frombuffer(b"".join(each), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
        totals = flat[np.cumsum(sizes) - 1] if len(each) else flat
        return flat + np.repeat(np.cumsum(totals) - totals, sizes)


def longest(prefixes: np.ndarray, limit: int) -> int:
    """Characters of the longest prefix that has at most ``limit`` tokens."""
    fits = np.flatnonzero(prefixes <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounter:
    return WordCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, fit_chars)`` per row, without a shuffle.

    fit_chars: characters, but for white space, of the longest prefix that fits the limit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                words = [by.words(t) for t in texts]
                by.learn(set().union(*words))
                rows = []
                for t, w in zip(texts, words, strict=True):
                    total = sum(map(by.totals.__getitem__, w))
                    fits = sum(map(len, w)) if total <= limit else longest(by.prefixes(w), limit)
                    rows.append((len(t.encode("utf-8", "surrogatepass")), total, total > limit, fits))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.bool_() if k == 2 else pa.int64()) for k, c in enumerate(columns))],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
                )

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
