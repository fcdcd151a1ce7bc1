"""Corpus pipeline over ``documents``: each stage is written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import jaccard, mixing, pieces, pii, quality
from spanloom.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a similarity of 0.8 or more on five-word shingles: the
    Gray-order SimHash index at a wide radius finds the pairs, their shingles verify them."""
    return jaccard.keep_one(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to surrogates; n_chars follows the new text."""
    return pii.replaced(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources have them read, for a budget of as
    many tokens as there are."""
    return mixing.remixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every document."""
    coded = pieces.encoded(docs, pieces.model_path())
    return coded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii_surrogates", surrogates),
    ("source_mixing", mixed_sources),
    ("sentencepiece", encoded),
]

#: Fingerprints, surrogates and pieces are beyond SQL. Each stage's operator is tested against brute force
#: (near copies, mixing), its library (pieces), SQL (quality) or formats and planted cases (surrogates).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
