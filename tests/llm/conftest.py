import pytest

#: A table with null cells, empty and long texts, repeated rows, ties, and columns of clashing names.
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, kind string, doc long, n_words long, a long, mark long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    plain = "one two three four five six seven eight nine ten eleven twelve"
    texts = [plain, plain, None, "", "  \n\t", long, "é" * 5000, plain.upper(), "call +1 (523) 555-1055 now", "x"]
    rows = [(i, t, "en", "s1" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id at all here", None, "s2", 3), (3, "another text under id three", "en", "s2", 9)]
    return spark.createDataFrame([(*r, 7, "k", 5, 6, 1, 2) for r in rows], ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="session")
def small(spark):
    """Whole documents of the smallest tables, as (doc_id, text)."""
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
