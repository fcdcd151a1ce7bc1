"""Parse units: runs of lines that end with a terminal mark, of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What ends a sentence, and where a long one may be cut.
TERMINAL, SOFT = r"[.!?]$", r"[;:]$"
MAX_LINES = 12


def sentence_groups(scanned: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``unit``: a line's last character ends its group. One window per document."""
    before = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.rtrim("text").rlike(TERMINAL).cast("int")
    return scanned.withColumn("unit", F.coalesce(F.sum(ends).over(before), F.lit(0)).cast("int") + 1)


def grouped(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keys, unit, lines)`` of documents, one a row: ``sentence_groups`` with the lines
    (``array<struct<line, text>>``) of each. A document is grouped where it is read, without a shuffle.

    The lines of a document are joined again, numbered and with an empty one after each end of a group, and split there.
    """
    each = F.transform(F.split(text, "\n"), lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    kept = F.filter(each, lambda x: F.trim(x["text"]) != "")
    gap = lambda t: F.when(F.rtrim(t).rlike(TERMINAL), "\n").otherwise("")
    joined = F.array_join(F.transform(kept, lambda x: F.concat(x["line"].cast("string"), F.lit(" "), x["text"], gap(x["text"]))), "\n")
    parts = docs.select(*keys, F.posexplode(F.split(joined, "\n\n")).alias("at", "part"))
    numbered = lambda t: F.struct(F.substring_index(t, " ", 1).cast("int").alias("line"), F.substring(t, F.locate(" ", t) + 1, F.length(t)).alias("text"))
    lines = F.transform(F.filter(F.split("part", "\n"), lambda t: t != ""), numbered)
    return parts.filter("part <> ''").select(*keys, (F.col("at") + 1).alias("unit"), lines.alias("lines"))


def parts_of(soft: Column, limit: int = MAX_LINES) -> Column:
    """The part (from 1) of each line of a group, from its soft flags as a text of 0 and 1.

    While more than ``limit`` lines are left, the group is cut after the last soft line among the
    first ``limit``, else after ``limit`` lines.
    """
    cut = rf"(?=.{{{limit + 1}}})(?:.{{0,{limit - 1}}}1|.{{{limit}}})|.+"
    return F.flatten(F.transform(F.regexp_extract_all(soft, F.lit(cut), F.lit(0)), lambda part, k: F.array_repeat(k + 1, F.length(part))))


def split_long(grouped: DataFrame, keys: tuple[str, ...] = ("doc_id",), limit: int = MAX_LINES) -> DataFrame:
    """Adds ``part`` (from 1) to lines with ``unit``: parts of at most ``limit`` lines."""
    held = [c for c in grouped.columns if c not in (*keys, "unit", "line")]
    packed = grouped.groupBy(*keys, "unit").agg(F.sort_array(F.collect_list(F.struct("line", *held))).alias("rows"))
    soft = F.array_join(F.transform("rows", lambda r: F.when(F.rtrim(r["text"]).rlike(SOFT), "1").otherwise("0")), "")
    each = packed.select(*keys, "unit", F.inline(F.arrays_zip(F.col("rows").alias("row"), parts_of(soft, limit).alias("part"))))
    return each.select(*keys, "unit", "row.*", "part").select(*grouped.columns, "part")


def fixed_chunks(scanned: DataFrame, size: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``chunk``: so many lines each."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("line"))
    return scanned.withColumn("chunk", (F.floor((n - 1) / size) + 1).cast("int"))


def packed_chunks(units: DataFrame, size: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keys, unit, n_lines, chunk)``: whole units packed in order while they fit ``size`` lines."""
    lists = F.sort_array(F.collect_list(F.struct("unit", "n_lines")))
    state = F.struct(F.lit(0).alias("room"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("of"))

    def step(a: Column, u: Column) -> Column:
        fits = u["n_lines"] <= a["room"]
        chunk = F.when(fits, a["chunk"]).otherwise(a["chunk"] + 1)
        room = F.when(fits, a["room"] - u["n_lines"]).otherwise(F.lit(size) - u["n_lines"])
        return F.struct(room.alias("room"), chunk.alias("chunk"), F.concat(a["of"], F.array(chunk)).alias("of"))

    grouped = units.select(*keys, "unit", F.col("n_lines").cast("int").alias("n_lines")).groupBy(*keys).agg(lists.alias("us"))
    packed = grouped.select(*keys, "us", F.aggregate("us", state, step)["of"].alias("of"))
    return packed.select(*keys, F.explode(F.arrays_zip("us", "of")).alias("x")).select(*keys, F.col("x.us.unit").alias("unit"), F.col("x.us.n_lines").alias("n_lines"), F.col("x.of").alias("chunk"))
