"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.sources.staging import shared_folder

#: A word is a run of characters other than ASCII white space; ``bytes.split()`` cuts at just those.
WORD = r"[^\x20\x09-\x0D]+"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there.

    Lost executors cost nothing that was staged. The size of the files is known to the planner,
    so a join with the result is broadcast only if it is small enough.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_in = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``most_bytes`` of text, or one row."""
    col = batch.column(column)
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def opened(uri: str) -> tuple[files.FileSystem, str]:
    """The file system of a URI or path, and the path in it."""
    if "://" not in uri:
        return files.LocalFileSystem(), re.sub("^file:", "", uri)
    return files.FileSystem.from_uri(uri)


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, …, so that no name of its own can clash with a helper's."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``plain(docs)`` in ``rows`` under their own names."""
    return rows.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def at(docs: DataFrame, name: str) -> str:
    """What ``plain(docs)`` calls a column."""
    return f"c{docs.columns.index(name)}"


def replaced_column(docs: DataFrame, source: str, into: str, kind: str, made: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``docs`` with the column ``into`` (in the place of one of that name, else last) made from another
    one, a slice of about two megabytes of text at a time; no shuffle."""
    columns, place = docs.columns, docs.columns.index(source)
    where = columns.index(into) if into in columns else len(columns)
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]
    fields[where : where + 1] = [T.StructField(f"c{where}", T._parse_datatype_string(kind))]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = pa.RecordBatch.from_arrays(whole.columns, [f"c{i}" for i in range(len(columns))])
            text = pa.types.is_string(whole.column(place).type) or pa.types.is_large_string(whole.column(place).type)
            for batch in slices(whole, f"c{place}") if text else [whole]:
                held = batch.columns
                held[where : where + 1] = [made(batch.column(place))]
                yield pa.RecordBatch.from_arrays(held, names)

    out = docs.mapInArrow(run, T.StructType(fields))
    return out.toDF(*columns[:where], into, *columns[where + 1 :])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node, root the smallest.

    Each round ties every neighbour of a node, and the node, to the smallest name the node knows.
    All that is done is grouped minima (combined before the shuffle) and equi-joins; hub nodes never
    gather their neighbours in one task. Rounds are staged in the shared folder. Self loops keep
    their node. Nodes must not be null.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    before = None
    while True:
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        tied = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tied = tied.union(least.select("a", F.col("m").alias("b")))
        mirrored = tied.union(tied.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        after = staged(mirrored, "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_staged(both)
        both = after
        if before == tuple(mark):
            return both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
        before = tuple(mark)
