"""Main text of HTML pages by the recurrent block labeller, as a map over pages without a shuffle.

Defined results: a null or empty page has an empty text; repeated rows are treated one by one; pages
of any length are labelled whole; a column that has the name of the new one is replaced by it, and all
others are kept whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.blocks import main_texts
from spanloom.llm.common import at, plain, slices, table


def extracted(pages: DataFrame, markup: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without the markup column and with the main text, in place of a column of its name."""
    from pyspark.sql import types as T

    rows, markup_at = plain(pages), at(pages, markup)
    others = [i for i, name in enumerate(pages.columns) if rows.columns[i] != markup_at and name.lower() != into.lower()]
    # only what is kept travels to Python
    rows = rows.select(markup_at, *(rows.columns[i] for i in others))
    names = [*rows.columns[1:], "main_text"]
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("main_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, markup_at):
                texts = main_texts([x or "" for x in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, schema).toDF(*(pages.columns[i] for i in others), into)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
