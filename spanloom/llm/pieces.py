"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces is walked once over the text; at each place its output
links list the pieces that end there, and each relaxes the best score of that place (Viterbi). For a
unigram model the best path is the encoding. For a model of type BPE the best sum of scores is not the
library's result, so steps between pieces that merging would not leave side by side cost infinitely
much (see ``bpe``); the one path of finite cost is the library's encoding.

No piece holds a space sign after another character, nor (if the model allows) a letter beside any
other character, so texts are cut there and each distinct chunk is encoded once per worker.

Defined results: null and empty texts have no pieces and decode to an empty text; repeated rows are
encoded one by one; characters unknown to the model become their UTF-8 bytes, or in models without
byte pieces one unknown piece for each run of them. Other columns keep their names whatever these
are; a column that is named like the one to be added is replaced.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.bpe import Automaton, PrefixEncoder, merge
from spanloom.llm.common import replaced_column, slices, table

SPACE = "▁"
#: Distinct chunks whose pieces a worker remembers, and characters above which a chunk is cut further.
REMEMBERED, LONG = 200_000, 32
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2
#: What a character without a piece costs more than the worst piece of a unigram model.
UNKNOWN_COST = 10

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def chunk_pattern(pairs: set[tuple[str, str]]) -> re.Pattern:
    """Chunks that no piece spans: space signs with letters or with other characters after them.

    ``pairs``: neighbours inside pieces. Letters that stand beside other characters count as such.
    """
    letter = re.compile(r"[^\W\d_]")
    beside = {x for a, b in pairs if a != SPACE and bool(letter.match(a)) != bool(letter.match(b)) for x in (a, b) if letter.match(x)}
    odd = "".join(map(re.escape, sorted(beside)))
    # an odd letter splits the others from its own neighbours only if it is no part of their words
    if any((a in beside) != (b in beside) and letter.match(a) and letter.match(b) for a, b in pairs):
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    other = rf"[\d_{odd}]+|[^\w{SPACE}]+"
    return re.compile(rf"{SPACE}*[^\W\d_{odd}]+|{SPACE}*(?:{other})+|{SPACE}+")


class PieceCodec:
    """Encoder and decoder of one model file; without ``encoding`` it decodes only and stays small."""

    def __init__(self, path: str, encoding: bool = True):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a BPE or unigram model without text normalisation is needed")
        if any(p.type not in (NORMAL, UNKNOWN, BYTE, 3) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        texts = [p.piece for p in model.pieces]
        if any(SPACE in t.lstrip(SPACE) for p, t in zip(model.pieces, texts, strict=True) if p.type == NORMAL):
            raise ValueError("pieces that go on after a space sign are not supported")
        self.byte_ids = [0] * 256
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == UNKNOWN), 0)
        self.bytewise = any(p.type == BYTE for p in model.pieces)
        self.raw = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.raw.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.raw.append(p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else model.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else b"")
        self.normal = [p.type == NORMAL for p in model.pieces]
        self.known: dict[str, bytes] = {}
        if not encoding:
            return
        score = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        letters = sorted({ord(c) for t in score for c in t})
        self.letters = np.array(letters, np.int64)
        number = {c: i for i, c in enumerate(letters)}
        pieces = [([number[ord(c)] for c in p.piece], i, False) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        pairs = {(ord(a), ord(b)) for t in score for a, b in zip(t, t[1:], strict=False)}
        self.cut = chunk_pattern({(chr(a), chr(b)) for a, b in pairs}).findall
        self.pairs = np.sort(np.array([a << 21 | b for a, b in pairs], np.int64))
        scores = np.array([p.score for p in model.pieces], np.float32)
        # letters that are no piece of their own get numbers beyond those of the model
        self.lone = [chr(c) for c in letters if chr(c) not in score]
        pieces += [([number[ord(c)]], len(texts) + k, False) for k, c in enumerate(self.lone)]
        scores = np.r_[scores, np.full(len(self.lone), min((p.score for p in model.pieces if p.type == NORMAL), default=0) - UNKNOWN_COST, np.float32)]
        texts = texts + self.lone

        def compatible(a: int, b: int) -> bool:
            parts = [texts[a], texts[b]] if a >= 0 else [texts[b]]
            return merge("".join(parts), lambda x, y: score.get(x + y)) == parts

        self.encoder = PrefixEncoder(Automaton(pieces, len(letters)), None if model.trainer_spec.model_type == UNIGRAM else compatible, scores)

    def spelled(self, character: str) -> np.ndarray:
        """Pieces of a character that is none."""
        return np.array([self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")] if self.bytewise else [self.unknown], np.int32)

    def chunks(self, text: str) -> list[str]:
        return self.cut(self.prefix + text.replace(" ", SPACE)) if text else []

    def learn(self, chunks: set[str]) -> None:
        """Remember the pieces (little-endian 32-bit numbers) of these chunks."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [c for c in chunks if c not in self.known]
        if not new:
            return
        sizes = np.array([len(c) for c in new], np.int64)
        codes = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        known = self.letters[place] == codes
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(new)), sizes)
        # cut before a character if it starts a chunk, stands next to an unknown one, or no piece spans the cut
        cut = np.r_[True, (owner[1:] != owner[:-1]) | ~known[1:] | ~known[:-1]]
        pair = codes[:-1] << 21 | codes[1:]
        spanned = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        cut[1:] |= (sizes[owner[1:]] > LONG) & ~spanned
        starts = np.flatnonzero(cut)
        stops = np.r_[starts[1:], len(codes)]
        made: list[bytes] = [b""] * len(starts)
        plain = np.flatnonzero(known[starts])
        for k in np.flatnonzero(~known[starts]).tolist():
            made[k] = self.spelled(chr(codes[starts[k]])).tobytes()
        words = [place[a:b] for a, b in zip(starts[plain].tolist(), stops[plain].tolist(), strict=True)]
        depth = self.encoder.automaton.depth
        for part, own, inner, _, counts in self.encoder.many(words, False):
            # walk all encodings back from their last pieces
            rows, at = np.arange(len(part)), own.copy()
            total = counts[own, rows]
            out = np.zeros((len(part), int(total.max(initial=0))), np.int32)
            place_of, live = total - 1, rows
            while len(live):
                piece = inner[at[live], live]
                out[live, place_of[live]] = piece
                at[live] -= self.lengths(depth)[piece]
                place_of[live] -= 1
                live = live[at[live] > 0]
            for row, (k, n) in enumerate(zip(part.tolist(), total.tolist(), strict=True)):
                own = out[row, :n]
                if self.lone and own.max(initial=0) >= len(self.raw):
                    own = np.concatenate([self.spelled(self.lone[i - len(self.raw)]) if i >= len(self.raw) else np.array([i], np.int32) for i in own.tolist()])
                made[plain[k]] = own.tobytes()
        first = np.searchsorted(starts, ends - sizes).tolist()
        for c, a, b in zip(new, first, [*first[1:], len(starts)], strict=True):
            self.known[c] = made[a] if b == a + 1 else b"".join(made[a:b])

    def lengths(self, depth: np.ndarray) -> np.ndarray:
        """Characters of each piece."""
        if not hasattr(self, "_lengths"):
            inner = self.encoder.automaton.inner
            self._lengths = np.zeros(len(self.raw) + len(self.lone), np.int64)
            self._lengths[inner[inner >= 0]] = depth[inner >= 0]
        return self._lengths

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        lists = [self.chunks(t) for t in texts]
        self.learn(set().union(*lists))
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, x)), np.int32) for x in lists]
        if self.bytewise:
            return ids
        return [x[np.r_[True, (x[1:] != self.unknown) | (x[:-1] != self.unknown)]] if len(x) else x for x in ids]

    def decode(self, ids: np.ndarray) -> str:
        numbers = ids.tolist()
        raw = b"".join(map(self.raw.__getitem__, numbers))
        lead = next((i for i in numbers if self.raw[i]), None)
        if self.prefix and lead is not None and self.normal[lead] and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "each-byte")


@lru_cache(maxsize=2)
def codec(path: str, encoding: bool = True) -> PieceCodec:
    return PieceCodec(path, encoding)


def encoded(docs: DataFrame, path: str, text: str = "text", into: str = "piece_ids") -> DataFrame:
    """``docs`` with an array of piece numbers; no shuffle. Texts are encoded whole."""

    def run(values: pa.Array) -> pa.Array:
        ids = codec(path).encode([t or "" for t in values.to_pylist()])
        offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))

    return replaced_column(docs, text, into, "array<int>", run)


def decoded(rows: DataFrame, path: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of an array of piece numbers; a null array gives an empty text."""

    def run(column: pa.Array) -> pa.Array:
        by = codec(path, False)
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        return pa.array([by.decode(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)], pa.string())

    return replaced_column(rows, ids, into, "string", run)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def round_trips(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_pieces, piece_ids, pieces_sha256, round_trip)``: encoded, and decoded again in the same
    task, where the codec is at hand. The hash is over the decimal numbers, spaced."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = codec(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [t or "" for t in batch.column(1).to_pylist()]
                ids = by.encode(texts)
                rows = [(len(x), hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest(), by.decode(x) == t) for x, t in zip(ids, texts, strict=True)]
                n, digest, same = zip(*rows, strict=True)
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), listed, pa.array(digest), pa.array(same)], ["doc_id", "n_pieces", "piece_ids", "pieces_sha256", "round_trip"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, pieces_sha256 string, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole document, and whether they decode to the text again."""
    return round_trips(table(spark, sf_dir, "documents"), model_path())
