"""Search for tokens by what the layers say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import loose_equal, parts

#: Fields of a query, and how each is compared with the wide row of a token.
FIELDS = {
    "word": lambda v: loose_equal(F.lit(v), F.col("word")),
    "lemma": lambda v: F.lower("lemma") == v.lower(),
    "pos": lambda v: F.lower("pos").contains(v.lower()),
    "deprel": lambda v: F.col("deprel") == v,
    "case": lambda v: F.array_contains(parts(F.coalesce("case", F.lit(""))), v),
}


def search(tokens: DataFrame, query: dict[str, str], limit: int, without: int | None = None) -> DataFrame:
    """The first ``limit`` tokens, by document, line and token, that meet all fields of a query.

    ``without``: a document that must not be searched. An empty query, an unknown field or a limit
    below one is an error.
    """
    unknown = sorted(set(query) - set(FIELDS))
    if unknown or not query or limit < 1:
        raise ValueError(f"unknown fields {unknown}" if unknown else "an empty query" if not query else f"no limit: {limit}")
    rows = tokens if without is None else tokens.filter(F.col("doc_id") != without)
    for field, value in query.items():
        rows = rows.filter(FIELDS[field](value))
    return rows.orderBy("doc_id", "line", "token").limit(limit)
