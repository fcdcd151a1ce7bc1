"""Aligners on damaged tables, against plain restatements."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import align

WORDS = ["l'", "aura", "che", "d'", "oro", "e", "poco", "a", "Poco", "mar"]


def chunks(rng, n):
    """Chunks of lines, and for each the words of all lines in order with some lost, added, moved or misspelt."""
    lines, table = [], []
    for chunk in range(n):
        texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 6))) + rng.choice(["", ".", ","]) for _ in range(rng.randint(1, 5))]
        words = [w for t in texts for w in re.findall(r"'?[^\W\d_]+'?", t)]
        for _ in range(rng.randint(0, 4)):
            kind, at = rng.randint(0, 3), rng.randrange(len(words) + 1)
            if kind == 0:
                words[at : at + 1] = []
            elif kind == 1:
                words.insert(at, rng.choice(["zzz", "-", "oro", "12"]))
            elif kind == 2 and len(words) > 1:
                words.insert(rng.randrange(len(words)), words.pop(at % len(words)))
            elif words:
                words[at % len(words)] += "x"
        lines += [(1, chunk, 10 + i, t) for i, t in enumerate(texts)]
        table += [(1, chunk, k, w) for k, w in enumerate(words)]
    return lines, table


def plain_buckets(texts, rows):
    """Row numbers by line: a queue of rows that wait for the next one that is found."""
    rows = [(k, w) for k, w in rows if any(c.isalpha() for c in w)]
    out = {i: [] for i in range(len(texts))}
    ln, at, wait, used = 0, 0, [], False
    for k, w in rows:
        if ln == len(texts) - 1 and (len(texts) == 1 or out.get("end")):
            out[ln].append(k)
            continue
        here = texts[ln].find(w, at)
        there = texts[ln + 1].find(w) if here < 0 and ln + 1 < len(texts) else -1
        if there >= 0:
            if not used:
                out[ln] += wait
            elif wait and any(c.isalpha() for c in texts[ln + 1][:there]):
                out[ln + 1].append(wait[-1])
            ln, here, wait = ln + 1, there, []
            out["end"] = ln == len(texts) - 1
        if here >= 0:
            out[ln] += [*wait, k]
            wait, at = [], here + len(w)
            used = not any(c.isalpha() for c in texts[ln][at:])
        else:
            wait.append(k)
    out.pop("end", None)
    return {i: v for i, v in out.items() if v}


def test_feature_rows(spark):
    rng = random.Random(1)
    lines, table = chunks(rng, 400)
    got = {}
    df = align.feature_rows(spark.createDataFrame(lines, "doc_id long, chunk int, line int, text string").repartition(3), spark.createDataFrame(table, "doc_id long, chunk int, row int, word string").repartition(3), ["doc_id", "chunk"])
    for r in df.orderBy("chunk", "line", "place").collect():
        got.setdefault(r.chunk, {}).setdefault(r.line - 10, []).append(r.row)
    lost = 0
    for chunk in range(400):
        rows = [(k, w) for _, c, k, w in table if c == chunk]
        want = plain_buckets([t for _, c, _, t in lines if c == chunk], rows)
        assert got.get(chunk, {}) == want, chunk
        lost += len(rows) - sum(map(len, want.values()))
    assert lost > 20


@pytest.mark.parametrize(("word", "token", "same"), [("*mi*", "mi", True), ("Mi,", "mi", True), ("mi", "parlarmi", True), ("i", "parlarmi", False), ("parlarmi", "mi", False), ("mi", "mio", False), (" mi ", "mi", True)])
def test_names_token(spark, word, token, same):
    assert spark.createDataFrame([(word, token)], "w string, t string").select(align.names_token(F.col("w"), F.col("t"))).first()[0] is same


def test_annex_rows(spark):
    rng = random.Random(2)
    targets, table, want = [], [], {}
    words = ["mi", "che", "lui", "parlarmi", "vedervi"]
    cells = ["mi", "che", "Lui.", "*vi*", "vedervi", "x", " "]
    for unit in range(300):
        asked = [rng.choice(words) for _ in range(rng.randint(1, 8))]
        rows = [(rng.choice(cells), rng.choice(["nom", "acc.", "dat + acc"])) for _ in range(rng.randint(0, 9))]
        targets += [(unit, i, w) for i, w in enumerate(asked)]
        table += [(unit, k, w, c) for k, (w, c) in enumerate(rows)]
        at = -1
        for i, w in enumerate(asked):
            fits = [k for k, (c, _) in enumerate(rows) if k > at and (b := c.strip().strip("*").rstrip(".").lower()) and (b == w or (len(b) > 1 and w.endswith(b)))]
            at = fits[0] if fits else at
            want[unit, i] = (fits[0], {"nom": "nominative", "acc.": "accusative"}.get(rows[at][1], "dative+accusative")) if fits else (None, "")
    df = align.annex_rows(spark.createDataFrame(targets, "unit int, at int, word string"), spark.createDataFrame(table, "unit int, row int, word string, case string"), ["unit"])
    got = {(r.unit, r.at): (r.row, r.case) for r in df.collect()}
    assert got == want and 100 < sum(r is None for r, _ in want.values()) < len(want) - 300


def tokens_of(text):
    return re.findall(r"'?[^\W\d_]+'?", text)


def runs(tokens, needle):
    return [i + 1 for i in range(len(tokens) - len(needle) + 1) if all(a.strip("'") == b.strip("'") and (a == b or a.strip("'") + "'" in (a, b) or "'" + a.strip("'") in (a, b)) for a, b in zip(needle, tokens[i:], strict=False))]


def test_claimed_spans(spark):
    """Repeated phrases go to different occurrences, in the named line first."""
    rng = random.Random(3)
    lines, table, want = [], [], {}
    for chunk in range(300):
        texts = {10 + i: " ".join(rng.choices(["poco", "a", "l'", "aura", "l"], k=rng.randint(1, 7))) for i in range(rng.randint(1, 3))}
        rows = []
        for k in range(rng.randint(1, 9)):
            t = tokens_of(rng.choice(list(texts.values())))
            i = rng.randrange(len(t))
            phrase = t[i : i + rng.randint(1, 3)]
            rows.append((k, rng.choice([10, 11, 12, None]), " ".join(phrase), rng.choice(["", phrase[0], phrase[-1], "zzz"])))
        lines += [(chunk, n, t) for n, t in texts.items()]
        table += [(chunk, *r) for r in rows]
        taken = set()
        for k, label, phrase, head in rows:
            needle = tokens_of(phrase)
            free = [(n != label, n, s) for n in sorted(texts) for s in runs(tokens_of(texts[n]), needle) if (tuple(needle), n, s) not in taken]
            if not free:
                want[chunk, k] = (None, None, None, None)
                continue
            _, n, s = min(free)
            taken.add((tuple(needle), n, s))
            t, e = tokens_of(texts[n]), s + len(needle) - 1
            h = next((i for i in range(s, e + 1) if head and runs([t[i - 1]], [head])), e)
            want[chunk, k] = (n, s, e, h)
    df = align.claimed_spans(spark.createDataFrame(lines, "chunk int, line int, text string"), spark.createDataFrame(table, "chunk int, row int, label int, phrase string, head string"), ["chunk"])
    got = {(r.chunk, r.row): (r.line, r.start, r.end, r.head) for r in df.collect()}
    assert got == want and sum(v[0] is None for v in want.values()) > 20


def test_spread_repeats(spark):
    text = "a poco a poco a Poco"
    rows = [(1, 1, 0, 2, 2, 2), (1, 1, 1, 2, 2, 2), (1, 1, 2, 2, 2, 2), (1, 1, 3, 1, 2, 2), (1, 1, 4, 1, 2, 2), (1, 1, 5, 3, 4, 3), (1, 1, 6, 1, 2, 1)]
    df = align.spread_repeats(spark.createDataFrame(rows, "doc_id long, line int, row int, start int, end int, head int"), spark.createDataFrame([(1, 1, text)], "doc_id long, line int, text string"), ["doc_id"])
    assert sorted((r.row, r.start, r.end, r.head) for r in df.collect()) == [(0, 2, 2, 2), (1, 4, 4, 4), (2, 2, 2, 2), (3, 1, 2, 2), (4, 1, 2, 2), (5, 3, 4, 3), (6, 1, 2, 1)]


def plain_merge(lines):
    out, head, i = [], None, 0
    cells = lambda t: [c.strip() for c in t.rstrip().split("|")[1:-1]]
    while i < len(lines):
        rule = i + 1 < len(lines) and lines[i + 1].startswith("|") and "---" in lines[i + 1]
        if lines[i].startswith("|") and rule and head is not None and cells(lines[i]) == head:
            while out and not lines[out[-1]].strip():
                out.pop()
            i += 2
            continue
        if lines[i].startswith("|") and rule and head is None:
            head = cells(lines[i])
        out.append(i)
        i += 1
    return out


def test_merged_tables(spark):
    rng = random.Random(4)
    pool = ["| a | b |", "| a | b |", "|---|---|", "|---|---|", "| x | y |", "", "  ", "text", "| a|b | ", " | a | b |"]
    tables = [[rng.choice(pool) for _ in range(rng.randint(1, 14))] for _ in range(500)]
    tables += [["| --- |"] * 7, ["| a | b |", "|---|---|", "| a | b |", "|---|---|", "", "", "| a | b |", "|---|---|", "| 1 | 2 |"]]
    df = align.merged_tables(spark.createDataFrame([(t, i, x) for t, rows in enumerate(tables) for i, x in enumerate(rows)], "t int, line int, text string").repartition(3), ["t"])
    got = {}
    for r in df.orderBy("t", "line").collect():
        got.setdefault(r.t, []).append(r.line)
    assert got == {t: x for t, rows in enumerate(tables) if (x := plain_merge(rows))}
