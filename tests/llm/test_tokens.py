import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spanloom.llm import pieces, tokencount
from spanloom.llm.bpe import merge

ODD = ["", " ", "  a  b ", "İstanbul ΑΣ Σ ΣΑΣ ﬁ", "don't we're I'll 'rest ''s", "<|endoftext|> a<|startoftext|>b <|endof", "日本語のテキスト 中文。한국어", "💩💩 é é ▁x\t\ty\x00\x85\xa0z", "a" * 3000, "ab" * 500 + " " * 100 + "x", "שלום ١٢٣ ½ ².", "\r\n\r\n #$%^&*()!!! ...", "퟿￿", "123,456.789", "___init__ x_{y}"]


@pytest.fixture(scope="module")
def words():
    return tokencount.counter(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def codec():
    return pieces.codec(pieces.model_path()), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_counts_equal_the_library(words, small):
    by, library = words
    texts = ODD + [t for _, t in small]
    cut = [by.words(t) for t in texts]
    by.learn(set().union(*cut))
    assert [int(p[-1]) if len(p) else 0 for p in map(by.prefixes, cut)] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix(words, small):
    by, library = words
    r = random.Random(0)
    for word in [*r.sample([w for _, t in small for w in by.words(t)], 150), "'re", "'ve", "naïveté", "!!!!!!!"]:
        by.learn({word})
        want = [len(library.encode(word[: k + 1], add_special_tokens=False).ids) for k in range(len(word))]
        assert by.prefixes([word]).tolist() == want, word


def test_every_prefix_of_a_text(words, small):
    """The counts at all characters are those that the library gives for the text cut there."""
    by, library = words
    for text in ["don't we're I'll 'rest ''s x", *(t for _, t in small[:12] if len(t) < 1500)]:
        cut = by.words(text)
        by.learn(set(cut))
        got, places = by.prefixes(cut), [k for k, c in enumerate(text) if not c.isspace()]
        assert len(got) == len(places)
        want = [len(e.ids) for e in library.encode_batch([text[: k + 1] for k in places], add_special_tokens=False)]
        assert got.tolist() == want


def test_what_fits(words, small):
    by, _ = words
    for _, text in small[:40]:
        cut = by.words(text)
        by.learn(set(cut))
        at = by.prefixes(cut)
        for limit in (0, 7, 50, 10**9):
            n = tokencount.longest(at, limit)
            assert (n == 0 or at[n - 1] <= limit) and (at[n:] > limit).all()
    by.learn(set(cut := by.words("one <|endoftext|> two")))
    assert tokencount.longest(by.prefixes(cut), 1) == 3 and tokencount.longest(by.prefixes(cut), 2) == 3 + len("<|endoftext|>")


def test_count_query(spark, small, words):
    got = {r.doc_id: r for r in tokencount.op9_token_counts(spark, "/root/testdata/sf0.001").collect()}
    want = words[1].encode_batch([t for _, t in small], add_special_tokens=False)
    for (i, t), e in zip(small, want, strict=True):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), len(e.ids), len(e.ids) > 2048)


def test_odd_counts(spark, odd_docs, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = tokencount.token_counts(odd_docs, path).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id == 2} == {(0, 0)}
    assert tokencount.token_counts(no_docs, path).collect() == []


def test_pieces_equal_the_library(codec, small):
    by, library = codec
    texts = ODD + [t for _, t in small]
    made = by.encode(texts)
    assert [x.tolist() for x in made] == library.encode(texts)
    assert [by.decode(x) for x in made] == library.decode([x.tolist() for x in made])


def test_decoding_any_numbers(codec):
    by, library = codec
    r = random.Random(1)
    for _ in range(200):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(12)]
        assert by.decode(np.array(ids)) == library.decode(ids)


def test_piece_query(spark, small, codec):
    rows = {r.doc_id: r for r in pieces.op6_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    for i, t in small:
        assert rows[i].n_pieces == len(codec[1].encode(t)) and rows[i].round_trip


def test_odd_pieces(spark, odd_docs, no_docs):
    path = pieces.model_path()
    back = pieces.decoded(pieces.encoded(odd_docs, path), path)
    assert back.columns == [*odd_docs.columns, "piece_ids", "decoded"]
    assert all(r.decoded == (r.text or "") for r in back.collect())
    assert pieces.decoded(pieces.encoded(no_docs, path), path).collect() == []
    assert pieces.round_trips(odd_docs, path).count() == odd_docs.count()


def test_merge_is_leftmost_and_by_rank():
    ranks = {("a", "a"): 0, ("aa", "aa"): 1, ("b", "c"): -1}
    assert merge("aaaaa", lambda x, y: ranks.get((x, y))) == ["aaaa", "a"]
    assert merge("abca", lambda x, y: ranks.get((x, y))) == ["a", "bc", "a"]


def unigram_model(byte_pieces: bool) -> bytes:
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.trainer_spec.model_type = 1
    model.trainer_spec.byte_fallback = byte_pieces
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = True
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)] if byte_pieces else []
    # no piece of its own: z; several cuts of the same word compete by score
    rows += [(t, -s, 1) for t, s in {"▁": 3.1, "a": 4.3, "b": 4.1, "ab": 5.2, "▁a": 5.0, "ba": 6.9, "abab": 9.8, "aba": 8.15, "▁ab": 6.05, "bz": 7.7, "bb": 8.9, "▁abz": 9.0, ".": 5.5}.items()]
    for piece, score, kind in rows:
        model.pieces.add(piece=piece, score=score, type=kind)
    return model.SerializeToString()


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_unigram_models(tmp_path, byte_pieces):
    """The relaxed scores give the library's best path; characters without a piece included."""
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model(byte_pieces))
    by, library = pieces.PieceCodec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    r = random.Random(3)
    texts = ["", " ", "abab", "zz ab", "é a", "abzab  bz.", *("".join(r.choice("aaabbbz .é") for _ in range(r.randint(1, 40))) for _ in range(300))]
    made = by.encode(texts)
    assert [x.tolist() for x in made] == library.encode(texts)


def test_ids_are_returned(spark, small):
    rows = {r.doc_id: r for r in pieces.op6_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert all(rows[i].piece_ids == ids and rows[i].n_pieces == len(ids) for (i, _), ids in zip(small, library.encode([t for _, t in small]), strict=True))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x"), (2, None, 6, "y")], "piece_ids long, text string, c0 long, decoded string")
    back = pieces.decoded(pieces.encoded(df, pieces.model_path()), pieces.model_path())
    assert back.columns == ["piece_ids", "text", "c0", "decoded"]
    assert [(r.text, r.c0, r.decoded) for r in back.orderBy("c0").collect()] == [("a b", 5, "a b"), (None, 6, "")]
