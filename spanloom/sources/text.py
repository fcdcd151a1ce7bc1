"""Scans of raw text. Positions are 1-based; ``token`` counts tokens with a letter only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import alpha_tokens


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per line that is not blank; lines are numbered before blank ones go."""
    each = docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "text"))
    return each.filter(F.trim("text") != "").select(*keys, (F.col("at") + 1).alias("line"), "text")


def line_range(scanned: DataFrame, first: int, last: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines ``first`` to ``last`` of the documents that reach to the last one.

    A range that runs backwards or starts before 1 is an error, whatever the documents hold.
    """
    from pyspark.sql import Window

    if not 1 <= first <= last:
        raise ValueError(f"no range of lines: {first}-{last}")
    reach = F.max("line").over(Window.partitionBy(*keys))
    return scanned.withColumn("reach", reach).filter(F.col("reach").cast("int") >= last).filter(F.col("line").between(first, last)).drop("reach")


def tokens(scanned: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keys, line, token, word)``."""
    return scanned.select(*keys, "line", F.posexplode(alpha_tokens(F.col("text"))).alias("at", "word")).select(*keys, "line", (F.col("at") + 1).alias("token"), "word")


def read_book(spark: SparkSession, folder: str) -> DataFrame:
    """Files ``<group>/<nn>.txt`` as ``(group, doc_no, line, text)``."""
    files = spark.read.text(f"{folder}/*/[0-9][0-9].txt", wholetext=True).withColumn("path", F.input_file_name())
    keyed = files.select(F.regexp_extract("path", r"([^/]+)/\d\d\.txt$", 1).alias("group"), F.regexp_extract("path", r"(\d\d)\.txt$", 1).cast("int").alias("doc_no"), F.col("value").alias("text"))
    return lines(keyed, keys=("group", "doc_no"))


def catalog(scanned: DataFrame, groups: list[str]) -> DataFrame:
    """Groups that hold a document, in the given order, with their document numbers."""
    order = F.create_map(*(F.lit(x) for pair in ((g, i) for i, g in enumerate(groups)) for x in pair))
    return scanned.select("group", "doc_no").distinct().filter(F.col("group").isin(groups)).withColumn("rank", F.element_at(order, F.col("group"))).orderBy("rank", "doc_no")


def documents_of(scanned: DataFrame, group: str) -> list[int]:
    """Sorted document numbers of a group; an unknown group is an error."""
    found = [r[0] for r in scanned.filter(F.col("group") == group).select("doc_no").distinct().orderBy("doc_no").collect()]
    if not found:
        raise FileNotFoundError(f"no documents for {group}")
    return found


def artifact_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the bytes of every file below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def pipe_rows(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of pipe-separated cells: ``(keys, line, n_cells, cells)``; outer pipes are optional."""
    rows = lines(docs, text, keys).filter(F.col("text").contains("|"))
    inner = F.regexp_replace(F.trim("text"), r"^\||\|$", "")
    return rows.select(*keys, "line", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells")).withColumn("n_cells", F.size("cells"))


def call_blocks(rows: DataFrame, text: str, keys: tuple[str, ...]) -> DataFrame:
    """Blocks ``<tool_call>{json}</tool_call>`` of a text: ``(keys, block, name, arguments, error)``.

    Broken blocks are rows with an error, not failures.
    """
    parts = rows.select(*keys, F.posexplode(F.slice(F.split(text, "<tool_call>"), F.lit(2), F.size(F.split(text, "<tool_call>")))).alias("at", "part"))
    body = F.trim(F.substring_index("part", "</tool_call>", 1))
    closed = F.col("part").contains("</tool_call>")
    name, arguments = F.get_json_object(body, "$.name"), F.get_json_object(body, "$.arguments")
    error = (
        F.when(~closed, "unterminated").when(F.get_json_object(body, "$").isNull() | ~body.startswith("{"), "not an object").when(F.coalesce(name, F.lit("")) == "", "no name")
    )
    return parts.select(*keys, (F.col("at") + 1).alias("block"), F.when(error.isNull(), name).alias("name"), F.when(error.isNull(), arguments).alias("arguments"), error.alias("error"))


def read_layer(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A tab-separated layer without quoting: ``(path, row, columns)`` with rows in file order.

    The header is skipped, blank lines are, missing trailing cells are empty strings. A file is read whole, so
    ``write_layer`` bounds their rows.
    """
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("row", "line")).filter((F.col("row") > 0) & (F.trim("line") != ""))
    cells = F.split("line", "\t")
    return rows.select("path", "row", *(F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)))


def numbered_tokens(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Feature rows of a layer with their token number: the place in file order among the rows of a line, which
    may go on in the next file of its writer."""
    from pyspark.sql import Window

    nth = F.regexp_extract("path", r"\.c(\d+)\.csv$", 1).try_cast("long")
    return rows.withColumn("token", F.row_number().over(Window.partitionBy(*keys).orderBy(nth, "row")))


#: Most rows of a file of a layer.
FILE_ROWS = 200_000


def write_layer(rows: DataFrame, path: str, order: list[str | Column], keys: list[str], most: int = FILE_ROWS) -> None:
    """A tab-separated layer with a header, one folder per key, rows in order, in files of at most ``most`` rows.

    The rows of one value of the first column of ``order`` are one task's, so their files are numbered in order.
    """
    rows.repartition(*keys, order[0]).sortWithinPartitions(*keys, *order).write.partitionBy(*keys).option("maxRecordsPerFile", most).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").mode("overwrite").csv(path)


def with_sentinels(rows: DataFrame, lines_: DataFrame, mark: str, keys: tuple[str, ...] = ("doc_id", "line")) -> DataFrame:
    """``rows`` and, for every line that has none, one row with 0 in ``mark`` and nothing else: the line
    was processed and holds nothing."""
    empty = lines_.select(*keys).distinct().join(rows.select(*keys).distinct(), list(keys), "left_anti")
    blank = [F.col(f.name) if f.name in keys else F.lit("" if f.dataType.simpleString() == "string" else 0).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    return rows.unionByName(empty.select(*blank)) if mark in rows.columns else rows


def without_sentinels(rows: DataFrame, mark: str, keys: tuple[str, ...] = ("doc_id", "line")) -> tuple[DataFrame, DataFrame]:
    """The rows of a layer, and all lines that were processed, also those that hold nothing."""
    return rows.filter(F.col(mark).cast("int") != 0), rows.select(*keys).distinct()


def parsed_reference(spec: str) -> tuple[str, int, int | None, int | None]:
    """``group n``, ``group n:a`` or ``group n:a-b`` as (group, document, first line, last line)."""
    import re

    found = re.fullmatch(r"\s*(\w+)\s+(\d+)(?::(\d+)(?:-(\d+))?)?\s*", spec)
    if not found:
        raise ValueError(f"not a reference: {spec!r}")
    group, number, first, last = found.groups()
    first = int(first) if first else None
    last = int(last) if last else first
    if first is not None and not 1 <= first <= last:
        raise ValueError(f"no range of lines: {spec!r}")
    return group, int(number), first, last


def referred(scanned: DataFrame, spec: str) -> DataFrame:
    """The lines ``(group, doc_no, line, text)`` that a reference names."""
    group, number, first, last = parsed_reference(spec)
    rows = scanned.filter((F.col("group") == group) & (F.col("doc_no") == number))
    return rows if first is None else line_range(rows, first, last, ("group", "doc_no"))


def sections(scanned: DataFrame, is_header: Column, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines under headers: the header line before each line and the place below it; lines before the
    first header go. One window per document."""
    from pyspark.sql import Window

    upto = Window.partitionBy(*keys).orderBy("line")
    header = F.last(F.when(is_header, F.struct(F.col("line").alias("at"), F.col("text").alias("title"))), ignorenulls=True).over(upto)
    marked = scanned.withColumn("header", header).withColumn("is_header", is_header).filter("header is not null and not is_header")
    place = F.row_number().over(Window.partitionBy(*keys, "header_line").orderBy("line"))
    return marked.select(*keys, "line", "text", F.col("header.at").alias("header_line"), F.col("header.title").alias("title")).withColumn("place", place)


def read_votes(spark: SparkSession, path: str, runs: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Answers as JSON lines: one row per id, one column per run."""
    rows = spark.read.schema("id string, run int, answer string").json(path).filter("id is not null")
    return rows.groupBy("id").pivot("run", list(runs)).agg(F.first("answer"))
