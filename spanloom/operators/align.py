"""Tables that a model wrote, brought back to the lines, tokens and positions that they speak of.

The rows of one chunk depend on each other in order, so each aligner is a fold over the rows of a chunk
(one grouping by chunk, then native expressions or a small walk in Python, in time in proportion to the chunk);
chunks are independent. Rows of different words never compete
for an occurrence, so spans are folded per chunk and phrase.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import alpha_tokens, canonical_case, has_alpha, loose_equal

#: What a word's end may carry, and the shortest clitic.
PUNCTUATION, SHORTEST = r"[.,;:!?»«\"]+$", 2


def _packed(rows: DataFrame, keys: list[str], order: str, fields: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *fields))).alias(name))


def _walked(packed: DataFrame, left: str, right: str, into: str, kind: str, walk: Callable[[list[dict], list[dict]], list]) -> DataFrame:
    """``packed`` with the column ``into``: what ``walk`` makes of the two lists of each chunk, few chunks at a time."""
    out = T.StructType([*packed.schema.fields, T.StructField(into, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                made = [walk(a, b) for a, b in zip(batch.column(left).to_pylist(), batch.column(right).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, to_arrow)], out.names)

    from pyspark.sql.pandas.types import to_arrow_type

    to_arrow = to_arrow_type(out[into].dataType)
    return packed.mapInArrow(run, out)


def placed_rows(lines: list[dict], rows: list[dict]) -> list[dict]:
    """The walk of ``feature_rows`` over one chunk: ``row``, the number ``ln`` of its line, its place in it."""
    letters = lambda t: any(map(str.isalpha, t))
    texts, n = [x["text"] for x in lines], len(lines)
    ln, start, wait, used, rest, out = 1, 0, [], False, n == 1, []
    for r in rows:
        row, word = r["row"], r["word"]
        if rest:
            out.append((row, ln))
            continue
        here = texts[ln - 1].find(word, start)
        beyond = texts[ln].find(word) if here < 0 and ln < n else -1
        if here < 0 and beyond < 0:
            wait.append(row)
            continue
        if beyond < 0:
            out += [(w, ln) for w in wait]
        else:
            if not used:
                out += [(w, ln) for w in wait]
            elif wait and letters(texts[ln][:beyond]):
                out.append((wait[-1], ln + 1))
            ln, rest = ln + 1, ln + 1 == n
        out.append((row, ln))
        start, wait = max(here, beyond) + len(word), []
        used = not letters(texts[ln - 1][start:])
    found, seen = [], dict.fromkeys(range(1, n + 1), 0)
    for row, ln in out:
        seen[ln] += 1
        found.append({"row": row, "ln": ln, "place": seen[ln]})
    return found


def feature_rows(lines: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, line, place, row)``: the rows of a chunk's table by the line that each belongs to.

    ``lines(keys, line, text)`` are the chunk's lines, ``table(keys, row, word)`` its rows. A cursor goes
    through the lines; a word is sought from it on, then in the next line. Rows that are not found wait:
    the next one that is found in the same line takes them along; one that is found in the next line leaves
    them in the old line, or, if that was used up, takes the last of them to the new line where letters stand
    before it, and the others are dropped. From the first word of the last line on all rows are its.
    """
    texts = _packed(lines, keys, "line", ["text"], "lines")
    rows = _packed(table.filter(has_alpha(F.col("word"))), keys, "row", ["word"], "rows")
    done = _walked(texts.join(rows, keys), "lines", "rows", "out", "array<struct<row:int,ln:int,place:int>>", placed_rows)
    numbers = F.transform("lines", lambda x: x["line"])
    out = done.select(*keys, numbers.alias("numbers"), F.explode("out").alias("x"))
    return out.select(*keys, F.element_at("numbers", F.col("x.ln")).alias("line"), F.col("x.place").alias("place"), F.col("x.row").alias("row"))


def bare_cell(word: Column) -> tuple[Column, Column]:
    """A cell without emphasis, and that in lower case without final punctuation."""
    left = F.trim(F.regexp_replace(F.trim(word), r"^\*+|\*+$", ""))
    return left, F.lower(F.regexp_replace(left, PUNCTUATION, ""))


def bare_text(word: str) -> tuple[str, str]:
    """``bare_cell`` of one cell."""
    left = re.sub(r"^\*+|\*+$", "", word.strip(" ")).strip(" ")
    return left, re.sub(PUNCTUATION, "", left).lower()


def bare_token(word: str) -> str:
    """A token in lower case without final punctuation."""
    return re.sub(PUNCTUATION, "", word.strip(" ")).lower()


def names_token(word: Column, token: Column) -> Column:
    """Whether a cell names a token: equal but for emphasis, case and final punctuation, or its clitic end."""
    left, bare = bare_cell(word)
    whole = F.lower(F.regexp_replace(F.trim(token), PUNCTUATION, ""))
    return (left == token) | (bare == whole) | ((F.length(bare) >= SHORTEST) & (F.length(bare) < F.length(whole)) & whole.endswith(bare))


def next_rows(want: list[dict], rows: list[dict]) -> list[int | None]:
    """The place (from 1) of the row that each position takes: the first after the last one taken that names it
    (``names_token``).

    Rows are found by their spelling: a token is looked up whole and by its ends of such lengths as rows have.
    """
    exact, bare = {}, {}
    for i, r in enumerate(rows):
        exact.setdefault(r["left"], []).append(i)
        bare.setdefault(r["bare"], []).append(i)
    lengths = sorted({len(b) for b in bare if len(b) >= SHORTEST})
    numbers = [r["row"] for r in rows]
    after, out = 0, []
    for t in want:
        word, end = t["word"], t["bare"]
        keys = [] if word is None else [exact.get(word), bare.get(end), *(bare.get(end[len(end) - n :]) for n in lengths if n < len(end))]
        hits = [p[k] for p in keys if p and (k := bisect_right(p, after - 1)) < len(p)]
        at = min(hits, default=None)
        out.append(None if at is None else at + 1)
        if at is not None:
            after = bisect_right(numbers, numbers[at])
    return out


def annex_rows(targets: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, at, word, case, row)``: for each expected position the next row that names it.

    A walk forward over ``table(keys, row, word, case)``: a position takes the first row after the last one
    taken; rows that name nothing expected are passed over. A position without a row has an empty case.
    """
    left, bare = bare_cell(F.col("word"))
    token = F.lower(F.regexp_replace(F.trim("word"), PUNCTUATION, ""))
    want = _packed(targets.withColumn("bare", token), keys, "at", ["word", "bare"], "want")
    named = table.filter(F.trim("word") != "").withColumns({"left": left, "bare": bare})
    rows = _packed(named, keys, "row", ["word", "case", "left", "bare"], "rows")
    both = want.join(rows, keys, "left").withColumn("rows", F.coalesce("rows", F.array().cast(rows.schema["rows"].dataType)))
    done = _walked(both, "want", "rows", "hits", "array<int>", next_rows)
    each = done.select(*keys, "rows", F.inline(F.arrays_zip("want", "hits")))
    hit = F.when(F.col("hits").isNotNull(), F.try_element_at("rows", "hits"))
    return each.select(*keys, F.col("want.at").alias("at"), F.col("want.word").alias("word"), F.coalesce(canonical_case(hit["case"]), F.lit("")).alias("case"), hit["row"].cast("long").alias("row"))


def _runs(tokens: DataFrame, needles: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, needle, found)``: where each phrase stands, as ``array<struct<line, start>>`` in order.

    ``tokens(keys, line, tokens)``; only lines that hold the phrase's first word are looked at.
    """
    loose = lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}]", ""))
    heads = tokens.select(*keys, "line", "tokens", F.explode(F.array_distinct(F.transform("tokens", loose))).alias("first"))
    asked = needles.select(*keys, "needle").distinct().withColumn("first", loose(F.col("needle")[0]))
    met = heads.join(asked, [*keys, "first"])
    n, m = F.size("tokens"), F.size("needle")
    starts = F.when(n >= m, F.sequence(F.lit(1), n - m + 1)).otherwise(F.array().cast("array<int>"))
    same = lambda i: F.forall(F.sequence(F.lit(1), m), lambda j: loose_equal(F.element_at("needle", j), F.element_at("tokens", i + j - 1)))
    each = met.select(*keys, "needle", "line", F.explode(F.filter(starts, same)).alias("start"))
    return each.groupBy(*keys, "needle").agg(F.sort_array(F.collect_list(F.struct("line", "start"))).alias("found"))


def claimed_spans(lines: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, row, line, start, end, head)`` of ``table(keys, row, label, phrase, head)``: each row takes the
    first occurrence of its phrase that no earlier row with it has, in the line it names, else in any; line is
    null for rows without one. The head is the first word of the span that the head cell names, else the last.
    """
    tokens = lines.select(*keys, "line", alpha_tokens(F.col("text")).alias("tokens"))
    rows = table.withColumn("needle", alpha_tokens(F.col("phrase"))).filter(F.size("needle") > 0)
    rows = rows.select(*keys, "row", "label", "needle", F.try_element_at(alpha_tokens(F.col("head")), F.lit(1)).alias("head_word"))
    queues = rows.groupBy(*keys, "needle").agg(F.sort_array(F.collect_list(F.struct("row", "label", "head_word"))).alias("queue"))
    both = queues.join(_runs(tokens, rows, keys), [*keys, "needle"], "left")
    line_type = lines.schema["line"].dataType.simpleString()
    place = f"struct<line:{line_type},start:int>"
    both = both.withColumn("found", F.coalesce("found", F.array().cast(f"array<{place}>")))

    def step(a: Column, r: Column) -> Column:
        free = F.filter("found", lambda p: ~F.array_contains(a["taken"], p))
        best = F.array_min(F.transform(free, lambda p: F.struct((~p["line"].eqNullSafe(r["label"])).alias("other"), p.alias("p"))))["p"]
        out = F.struct(r["row"].alias("row"), r["head_word"].alias("head_word"), best.alias("p"))
        return F.struct(F.when(best.isNotNull(), F.concat(a["taken"], F.array(best))).otherwise(a["taken"]).alias("taken"), F.concat(a["out"], F.array(out)).alias("out"))

    kind = f"array<struct<row:{table.schema['row'].dataType.simpleString()},head_word:string,p:{place}>>"
    start = F.struct(F.array().cast(f"array<{place}>").alias("taken"), F.array().cast(kind).alias("out"))
    done = both.select(*keys, F.size("needle").alias("m"), F.inline(F.aggregate("queue", start, step)["out"]))
    placed = done.select(*keys, "row", "head_word", "m", F.col("p.line").alias("line"), F.col("p.start").alias("start")).join(tokens, [*keys, "line"], "left")
    end = F.col("start") + F.col("m") - 1
    named = F.filter(F.sequence("start", end), lambda i: loose_equal(F.col("head_word"), F.element_at("tokens", i)))
    head = F.when(F.col("line").isNotNull(), F.coalesce(F.try_element_at(named, F.lit(1)), end))
    return placed.select(*keys, "row", "line", "start", end.alias("end"), head.alias("head"))


def spread_repeats(spans: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, line, row, start, end, head)``: exact repeats of a span moved to the next occurrence of its
    words in the line that no span has; where there is none they stay. ``spans(keys, line, row, start, end, head)``.
    """
    tokens = lines.select(*keys, "line", alpha_tokens(F.col("text")).alias("tokens"))
    whole = spans.select(*keys, "line", "row", *(F.col(c).cast("int").alias(c) for c in ("start", "end", "head")))
    rows = whole.join(tokens, [*keys, "line"]).withColumn("needle", F.slice("tokens", F.col("start"), F.col("end") - F.col("start") + 1))
    by = [*keys, "line"]
    again = F.row_number().over(Window.partitionBy(*by, "start", "end", "head").orderBy("row"))
    queues = rows.withColumn("again", again).groupBy(*by, "needle").agg(F.sort_array(F.collect_list(F.struct("row", "start", "end", "head", "again"))).alias("queue"), F.collect_set("start").alias("held"), F.first("tokens").alias("tokens"))
    n, m = F.size("tokens"), F.size("needle")
    same = lambda i: F.forall(F.sequence(F.lit(1), m), lambda j: loose_equal(F.element_at("needle", j), F.element_at("tokens", i + j - 1)))
    queues = queues.withColumn("runs", F.filter(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), same))

    def step(a: Column, s: Column) -> Column:
        free = F.filter("runs", lambda i: ~F.array_contains(a["held"], i))
        to = F.when(s["again"] > 1, F.try_element_at(free, F.lit(1)))
        moved = F.struct(s["row"].alias("row"), F.coalesce(to, s["start"]).alias("start"), F.coalesce(to + (s["end"] - s["start"]), s["end"]).alias("end"), F.coalesce(to + (s["head"] - s["start"]), s["head"]).alias("head"))
        return F.struct(F.when(to.isNotNull(), F.concat(a["held"], F.array(to))).otherwise(a["held"]).alias("held"), F.concat(a["out"], F.array(moved)).alias("out"))

    row = spans.schema["row"].dataType.simpleString()
    start = F.struct(F.col("held").cast("array<int>").alias("held"), F.array().cast(f"array<struct<row:{row},start:int,end:int,head:int>>").alias("out"))
    return queues.select(*by, F.inline(F.aggregate("queue", start, step)["out"]))


def merged_tables(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``lines(keys, line, text)`` without the repeated heads of chunked pipe tables.

    The first row of a text that a rule row follows is its head. Where it stands again with a rule row, both
    go, and the blank lines before them. A rule row that went with its head is not looked at as a head.
    """
    by = Window.partitionBy(*keys).orderBy("line")
    text = F.rtrim("text")
    pipe = text.startswith("|")
    cells = F.transform(F.split(text, r"\|"), lambda c: F.trim(c))
    cells = F.when(pipe, F.slice(cells, 2, F.greatest(F.size(cells) - 2, F.lit(0))))
    below = F.lead("text").over(by)
    rows = lines.withColumn("cells", cells).withColumn("heads", F.coalesce(pipe & F.rtrim(below).startswith("|") & below.contains("---"), F.lit(False)))
    first = rows.filter("heads").groupBy(*keys).agg(F.min("line").alias("first_line"), F.min_by("cells", "line").alias("first_cells"))
    rows = rows.join(first, keys, "left")
    rows = rows.withColumn("again", F.coalesce(F.col("heads") & (F.col("line") > F.col("first_line")) & (F.col("cells") == F.col("first_cells")), F.lit(False)))
    # of heads in a row every second one is the rule row of the one before
    run = F.row_number().over(by) - F.sum(F.col("again").cast("int")).over(by)
    nth = F.row_number().over(Window.partitionBy(*keys, "again", "run").orderBy("line"))
    rows = rows.withColumn("run", run).withColumn("gone", F.col("again") & (nth % 2 == 1))
    rows = rows.withColumn("blank", text == "").withColumn("rule", F.coalesce(F.lag("gone").over(by), F.lit(False)))
    after = F.first(F.when(~F.col("blank"), F.col("gone")), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("before", F.coalesce(after, F.lit(False)))
    return rows.filter(~F.col("gone") & ~F.col("rule") & ~(F.col("blank") & F.col("before"))).select(*keys, "line", "text")
