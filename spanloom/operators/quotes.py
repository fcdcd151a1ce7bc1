"""Quote forests: nested quotations found by matching marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import alpha_tokens

#: Opening marks and their closing ones.
MARKS = {"«": "»", "“": "”", "‘": "’"}


def marks(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keys, line, col, mark, opens, depth)``: every quotation mark with the depth of its quote."""
    each = docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "line_text"))
    either = "".join([*MARKS, *MARKS.values()])
    cut = each.filter(F.col("line_text").rlike(f"[{either}]")).select(*keys, (F.col("at") + 1).alias("line"), F.split("line_text", f"[{either}]").alias("rest"), F.regexp_extract_all("line_text", F.lit(f"[{either}]"), F.lit(0)).alias("signs"))
    # a mark stands after the parts of the line before it and the marks between them
    pairs = cut.select(*keys, "line", F.posexplode(F.arrays_zip(F.slice("rest", F.lit(1), F.size("signs")).alias("part"), F.col("signs").alias("mark"))).alias("k", "m"))
    before = Window.partitionBy(*keys, "line").orderBy("k")
    col = (F.sum(F.length("m.part") + 1).over(before) - 1).cast("int")
    flat = pairs.select(*keys, "line", col.alias("col"), F.col("m.mark").alias("mark"))
    opens = F.col("mark").isin(list(MARKS))
    upto = Window.partitionBy(*keys).orderBy("line", "col")
    level = F.sum(F.when(opens, 1).otherwise(-1)).over(upto)
    return flat.withColumn("opens", opens).withColumn("depth", (level + F.when(opens, 0).otherwise(1)).cast("int"))


def forest(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per quote: extent, depth, parent's place, and an error where marks do not match.

    A quote's end is the next mark of its depth.
    """
    of_depth = Window.partitionBy(*keys, "depth").orderBy("line", "col")
    nxt = [F.lead(c).over(of_depth).alias(f"end_{c}") for c in ("line", "col", "mark")]
    pairs = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))
    quotes = found.select("*", *nxt).filter("opens and depth > 0")
    matches = F.try_element_at(pairs, F.col("mark")) == F.col("end_mark")
    error = F.when(F.col("end_mark").isNull(), "unclosed").when(~matches, "mismatch").otherwise("")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("line", "col"))
    return quotes.select(*keys, number.alias("quote"), "line", "col", "end_line", "end_col", "mark", "depth", error.alias("error"))


def overlapping(quotes: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Quotes that touch a line range ``(keys, first, last)`` of their document."""
    return quotes.join(ranges, list(keys)).filter("line <= last and end_line >= first")


def ids(quotes: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``quote_id``: the line, with a letter (after ``Z``: a number) where several quotes open in it."""
    by = Window.partitionBy(*keys, "line")
    k = F.row_number().over(by.orderBy("col"))
    letter = F.when(k <= 26, F.chr(F.lit(64) + k)).otherwise(k.cast("string"))
    return quotes.withColumn("quote_id", F.concat(F.col("line").cast("string"), F.when(F.count("*").over(by) > 1, letter).otherwise("")))


def heads(quotes: DataFrame, docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``head``: where several quotes open in a line, as many of their first words as tell them apart
    (``?`` without any word); else empty. One grouping by line."""
    lines = docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "line_text")).select(*keys, (F.col("at") + 1).alias("line"), "line_text")
    several = quotes.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "line"))).filter("n > 1").select(*keys, "line", "col")
    words = alpha_tokens(F.substring("line_text", F.col("col") + 2, F.length("line_text")))
    groups = several.join(lines, [*keys, "line"]).groupBy(*keys, "line").agg(F.collect_list(F.struct("col", words.alias("words"))).alias("group"))
    # neighbours in order of their words tell how many words keep any two apart; 0: they are the same
    ranked = F.array_sort(F.transform("group", lambda x: x["words"]))
    few = F.size("group") - 1
    parts = F.zip_with(F.slice(ranked, F.lit(1), few), F.slice(ranked, F.lit(2), few), lambda a, b: F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True))
    widest = F.array_max(F.transform("group", lambda x: F.size(x["words"])))
    width = F.when(F.array_min(parts) == 0, widest + 1).otherwise(F.array_max(parts)).cast("int")
    each = groups.withColumn("width", width).select(*keys, "line", "width", F.inline("group"))
    named = each.select(*keys, "line", "col", F.when(F.size("words") == 0, "?").otherwise(F.array_join(F.slice("words", F.lit(1), F.col("width")), " ")).alias("head"))
    return quotes.join(named, [*keys, "line", "col"], "left").withColumn("head", F.coalesce("head", F.lit("")))


def escaped(text: Column) -> Column:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        text = F.replace(text, F.lit(sign), F.lit(f"&{name};"))
    return text


def as_xml(named: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keys, xml)`` from quotes with ids and heads: the well-formed quotes of a document as nested ``q``
    elements, one tag a line and indented; quotes without quotes in them close themselves."""
    good = named.filter("error = ''")
    follows = F.lead(F.struct("line", "col")).over(Window.partitionBy(*keys).orderBy("line", "col"))
    leaf = F.coalesce(follows > F.struct(F.col("end_line"), F.col("end_col")), F.lit(True))
    pairs = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))
    indent = F.repeat(F.lit("  "), F.col("depth"))
    attributes = {
        "id": F.col("quote_id"),
        "line": F.concat_ws("-", "line", F.when(F.col("end_line") != F.col("line"), F.col("end_line"))),
        "col": F.concat_ws("-", "col", "end_col"),
        "marker": F.concat("mark", F.element_at(pairs, F.col("mark"))),
        "head": F.when(F.col("head") != "", F.col("head")),
    }
    shown = F.concat(*(F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escaped(v), F.lit('"'))).otherwise("") for k, v in attributes.items()))
    placed = good.withColumn("leaf", leaf)
    begin = F.struct(F.col("line").alias("l"), F.col("col").alias("c"), F.concat(indent, F.lit("<q"), shown, F.when(F.col("leaf"), "/>").otherwise(">")).alias("tag"))
    end = F.struct(F.col("end_line").alias("l"), F.col("end_col").alias("c"), F.when(~F.col("leaf"), F.concat(indent, F.lit("</q>"))).alias("tag"))
    tags = placed.select(*keys, F.inline(F.array(begin, end))).filter("tag is not null")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l", "c", "tag"))), lambda x: x["tag"]), "\n")
    return tags.groupBy(*keys).agg(joined.alias("xml"))


def from_xml(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Quotes of nested ``q`` elements: ``(keys, quote_id, line, end_line, col, end_col, marker, head, depth)``."""
    tags = rows.select(*keys, F.posexplode(F.regexp_extract_all("xml", F.lit("</?q\\b[^>]*>"), F.lit(0))).alias("at", "tag"))
    begins, stays = ~F.col("tag").startswith("</"), F.col("tag").endswith("/>")
    upto = Window.partitionBy(*keys).orderBy("at")
    level = F.sum(F.when(~begins, -1).when(stays, 0).otherwise(1)).over(upto)
    opened = tags.withColumn("depth", (level + F.when(stays, 1).otherwise(0)).cast("int")).filter(begins)

    def cell(name: str) -> Column:
        value = F.regexp_extract("tag", rf' {name}="([^"]*)"', 1)
        for sign, short in (('"', "quot"), (">", "gt"), ("<", "lt"), ("&", "amp")):
            value = F.replace(value, F.lit(f"&{short};"), F.lit(sign))
        return value

    def ends(name: str) -> tuple[Column, Column]:
        value = cell(name)
        return F.substring_index(value, "-", 1).cast("int"), F.substring_index(value, "-", -1).cast("int")

    (line, end_line), (col, end_col) = ends("line"), ends("col")
    return opened.select(*keys, cell("id").alias("quote_id"), line.alias("line"), end_line.alias("end_line"), col.alias("col"), end_col.alias("end_col"), cell("marker").alias("marker"), cell("head").alias("head"), "depth")
