"""Small fixtures for branches that the tables seldom reach."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as fn
from spanloom.operators import edges, frames, quotes, score, spans, units
from spanloom.sources import text as src


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column, **cells):
    return spark.createDataFrame([cells]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("l'aura e 'l ciel", ["l'", "aura", " ", "e", " ", "'l", " ", "ciel"]), ("a1\n!", ["a", "1", "\n", "!"]), ("''", ["'", "'"]), ("è'", ["è'"]), ("", [])],
)
def test_all_tokens(spark, text, tokens):
    assert one(spark, fn.all_tokens(F.col("t")), t=text) == tokens


@pytest.mark.parametrize(("word", "token", "same"), [("ciel,", "ciel", True), ("ciela", "ciel", False), ("ciel", "ciel'", True), ("'l", "l", True), ("l", "'l", True), ("ciel'", "ciel", True), ("x", "y", False)])
def test_loose_equal(spark, word, token, same):
    assert one(spark, fn.loose_equal(F.col("w"), F.col("t")), w=word, t=token) is same


def test_cells(spark):
    assert one(spark, fn.canonical_case(F.col("c")), c=" Acc. + *dat* + odd") == "accusative+dative+odd"
    assert one(spark, fn.lenient_int(F.col("c")), c="(12)") == 12
    assert one(spark, fn.lenient_int(F.col("c")), c="none") is None
    assert one(spark, fn.is_verb(F.col("c")), c="adverb") is False
    assert one(spark, fn.pronoun_slots(F.col("c")), c="verb + pronoun + pronoun") == 2
    assert one(spark, fn.from_roman(F.col("c")), c="IIX") is None
    assert one(spark, fn.from_roman(F.col("c")), c="XLIV") == 44
    assert one(spark, fn.valid_role(F.col("c")), c="obl:über") is False
    assert one(spark, fn.valid_role(F.col("c")), c="obl:di") is True


@pytest.mark.parametrize("spec", ["", "1,,3", "-", "abc", "5-3", "1..3"])
def test_broken_ranges(spark, spec):
    with pytest.raises(ValueError):
        fn.range_filter(spec, F.col("line"))


def test_ranges(spark):
    assert [r.id for r in spark.range(30).filter(fn.range_filter("-2,5,8-9,27-", F.col("id"))).collect()] == [0, 1, 2, 5, 8, 9, 27, 28, 29]


def test_long_units(spark):
    """Thirteen lines with a soft mark, thirty without, twelve that need no cut."""
    rows = [(1, i, "x;" if i in (4, 9) else "x") for i in range(1, 14)] + [(2, i, "x") for i in range(1, 31)] + [(3, i, "x;") for i in range(1, 13)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, line int, text string, unit int")
    got = values(units.split_long(df).groupBy("doc_id", "part").count(), "doc_id", "part", "count")
    assert got == [(1, 1, 9), (1, 2, 4), (2, 1, 12), (2, 2, 12), (2, 3, 6), (3, 1, 12)]


def test_packing(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, 2), (1, 4, 9), (1, 5, 1)], "doc_id long, unit int, n_lines int")
    assert values(units.packed_chunks(df, 4), "unit", "chunk") == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 4)]


def test_quotes(spark):
    df = spark.createDataFrame([(1, "a «b “c\nd” e» f «g"), (2, "«a”"), (3, "»a «b»"), (4, "plain")], "doc_id long, text string")
    got = values(quotes.forest(quotes.marks(df)), "doc_id", "quote", "line", "col", "end_line", "end_col", "depth", "error")
    assert [x for x in got if x[0] == 1] == [(1, 1, 1, 2, 2, 4, 1, ""), (1, 2, 1, 5, 2, 1, 2, ""), (1, 3, 2, 8, None, None, 1, "unclosed")]
    assert [x[-1] for x in got if x[0] == 2] == ["mismatch"]
    ids = values(quotes.ids(quotes.forest(quotes.marks(df))).filter("doc_id = 1"), "quote", "quote_id")
    assert ids == [(1, "1A"), (2, "1B"), (3, "2")]


def test_nesting_of_crossing_spans(spark):
    df = spark.createDataFrame([(1, 1, 1, 6, 1), (1, 1, 2, 4, 2), (1, 1, 3, 6, 3), (1, 1, 3, 4, 3), (1, 1, 3, 4, 4)], "doc_id long, line int, start int, end int, head int")
    assert values(spans.nested(df), "ord", "start", "end", "parent") == [(1, 1, 6, 0), (2, 2, 4, 1), (3, 3, 6, 1), (4, 3, 4, 3), (5, 3, 4, 3)]


def unit(spark, rows):
    columns = "doc_id long, unit int, u int, head int, deprel string, word string, pos string, lemma string, person string"
    return spark.createDataFrame([(1, 1, *r) for r in rows], columns)


def test_edges_with_faults(spark):
    rows = [(1, 2, "conj", "a", "noun", "a", ""), (2, 3, "conj", "b", "noun", "b", ""), (3, 2, "obj", "c", "noun", "c", ""), (4, 4, "obj", "d", "noun", "d", ""), (5, 0, "nsubj", "e", "verb", "e", "")]
    got = values(edges.structure_violations(unit(spark, rows)), "u", "kind")
    assert got == [(1, "cycle"), (2, "cycle"), (3, "cycle"), (4, "cycle"), (4, "self_head"), (5, "root_label")]
    ends = values(edges.walks(unit(spark, rows)), "u", "coord_head")
    assert ends == [(1, 3), (2, 3), (3, 3), (4, 4), (5, 5)]


def test_frames(spark):
    rows = [
        (1, 2, "nsubj", "ella", "pronoun", "ella", "3"),
        (2, 0, "root", "parla", "verb", "parlare", "3"),
        (3, 4, "case", "di", "preposition", "di", ""),
        (4, 2, "obl", "lui", "pronoun", "lui", "3"),
        (5, 2, "ccomp", "viene", "verb", "venire", "3"),
        (6, 5, "advcl", "andare", "verb", "andare", ""),
    ]
    got = values(frames.derived(unit(spark, rows)), "pred", "role", "arg")
    assert got == [(2, "ccomp", 5), (2, "obl:di", 4), (2, "subj", 1), (5, "subj", 0), (6, "", 0)]
    assert values(frames.tuples(frames.derived(unit(spark, rows))), "pred", "args") == [(2, "subj=1 ccomp=5 obl:di=4"), (5, "subj=0"), (6, "")]


def test_divergence_and_repair(spark):
    columns = "doc_id long, unit int, pred int, role string, arg int, given boolean"
    rows = [(2, "subj", 0, True), (2, "obj", 4, True), (2, "subj", 1, False), (2, "obl", 4, False), (3, "obj", 1, True), (4, "obj", 1, False)]
    both = spark.createDataFrame([(1, 1, *r) for r in rows], columns)
    found = frames.divergence(frames.sided(both.filter("given"), both.filter("not given")))
    assert values(found, "pred", "arg", "kind", "role", "given_role") == [
        (2, 0, "extra_arg", "", "subj"),
        (2, 1, "missing_arg", "subj", ""),
        (2, 4, "role_mismatch", "obl", "obj"),
        (3, 0, "extra_tuple", "", ""),
        (4, 0, "missing_tuple", "", ""),
    ]
    assert values(frames.null_subject_repairs(found), "pred", "arg") == [(2, 1)]


def test_votes(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "a"), (2, 1, "b"), (2, 2, "a"), (2, 3, "a"), (3, 1, "c"), (3, 2, "b"), (3, 3, "a")], "id int, run int, answer string")
    got = values(score.majority(df, ["id"], "answer", "run"), "id", "winner", "verdict")
    assert got == [(1, "a", "unanimous"), (2, "a", "majority"), (3, "c", "split")]


def test_call_blocks(spark):
    text = 'x <tool_call>{"name": "f", "arguments": {"n": 1}}</tool_call> <tool_call>{oops</tool_call><tool_call>{"name": ""}</tool_call> <tool_call>{"name": "g"}'
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, text string")
    got = values(src.call_blocks(df, "text", ("id",)).select("id", "block", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("error", F.lit("")).alias("error")), "id", "block", "name", "error")
    assert got == [(1, 1, "f", ""), (1, 2, "", "not an object"), (1, 3, "", "no name"), (1, 4, "", "unterminated")]


def test_layer_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 1, ""), ("b", 1, 1, "y\"z")], "group string, line int, token int, word string")
    src.write_layer(rows, str(tmp_path / "layer"), ["line", "token"], ["group"])
    back = src.read_layer(spark, str(tmp_path / "layer/*/*.csv"), ["line", "token", "word"])
    assert values(back, "line", "token", "word") == [("1", "1", "x"), ("1", "1", 'y"z'), ("2", "1", "")]


def test_books(spark, tmp_path):
    for group, n, text in (("one", "01", "a\n\nb."), ("two", "03", "c")):
        (tmp_path / group).mkdir(exist_ok=True)
        (tmp_path / group / f"{n}.txt").write_text(text)
    book = src.read_book(spark, str(tmp_path))
    assert values(book, "group", "doc_no", "line", "text") == [("one", 1, 1, "a"), ("one", 1, 3, "b."), ("two", 3, 1, "c")]
    assert [tuple(r) for r in src.catalog(book, ["two", "one", "none"]).select("group", "doc_no").collect()] == [("two", 3), ("one", 1)]
    assert src.documents_of(book, "two") == [3]
    with pytest.raises(FileNotFoundError):
        src.documents_of(book, "three")
    assert src.artifact_hashes(spark, str(tmp_path)).count() == 2
