"""Quality rules with host-level verdicts.

Every document is measured on its whole text. Rule failures are counted by host, the failure rate
of each host is shrunk towards an empirical beta prior that is fitted to all hosts, and the host's
verdict is joined back to its documents. A host is rejected if its shrunk rate lies three deviations
of the prior above the prior's mean, but not below 30 %, and at any rate above 60 % (or half way from
the mean to 1, where most documents fail); its documents go with it.

Defined results: a null text has no words and fails the base rules; a null host is a host of its
own; repeated rows are measured and counted one by one; other columns are passed through untouched
whatever their names are; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import at, plain, restored, slices, staged, table

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Soft rules: shares in percent above which a document counts as failing for its host.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
#: A host is rejected so many deviations of the prior above its mean, within these bounds.
DEVIATIONS, SPARED, HOPELESS = 3.0, 0.3, 0.6

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeat_words(words: list[bytes]) -> int:
    """Words inside a 5-word window that occurs twice or more in the list."""
    n = len(words)
    if n <= WINDOW:
        return 0
    names: dict[bytes, int] = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
    if len(names) == n:
        return 0
    m = n - WINDOW + 1
    key, bound = ids[:m].copy(), len(names)
    for k in range(1, WINDOW):
        if bound * len(names) >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            bound = int(key.max()) + 1
        key = key * len(names) + ids[k : m + k]
        bound *= len(names)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(m, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    cover[:m] += hit
    cover[WINDOW : m + WINDOW] -= hit
    return int((np.cumsum(cover)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The signals of one whole text, in the order of SIGNALS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - blanks, sum(raw.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), len(lines))


def signals(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` and one for each signal; no shuffle."""
    narrow = rows.select(*keep, F.col(text).alias("measured"))
    schema = T.StructType([*narrow.drop("measured").schema.fields, *(T.StructField(x, T.LongType()) for x in SIGNALS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "measured", 8_000_000):
                values = np.array([measure(t) for t in batch.column(len(keep)).to_pylist()], np.int64).reshape(-1, len(SIGNALS)).T
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(np.ascontiguousarray(c)) for c in values)], [*keep, *SIGNALS])

    return narrow.mapInArrow(run, schema)


def judged(measured: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``failed`` (base or soft rules) to measured documents."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    return measured.withColumn("base_failed", base).withColumn("failed", base | soft)


def host_counts(judgements: DataFrame) -> DataFrame:
    """One row per host: documents and failures; combined before the shuffle, so a hot host is cheap."""
    return judgements.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("fails"))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters by the method of moments over all hosts (one row reaches the driver)."""
    n, k = F.col("n").cast("double"), F.col("fails").cast("double")
    row = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn")).first()
    if not row.hosts or not row.n:
        return 1.0, 1.0
    mean = min(max(row.k / row.n, 1e-6), 1 - 1e-6)
    spread = row.kk / row.n - mean * mean
    noise = mean * (1 - mean) * row.hosts / row.n
    between = (spread - noise) / max(1 - row.nn / row.n**2, 1e-9)
    size = mean * (1 - mean) / between - 1 if between > 0 else 1e4
    size = min(max(size, 1.0), 1e4)
    return mean * size, (1 - mean) * size


def threshold(a: float, b: float) -> float:
    """The shrunk rate above which a host is rejected under this prior."""
    mean = a / (a + b)
    deviation = (mean * (1 - mean) / (a + b + 1)) ** 0.5
    return min(max(mean + DEVIATIONS * deviation, SPARED), max(HOPELESS, (1 + mean) / 2))


def host_verdicts(hosts: DataFrame) -> DataFrame:
    """``(host, host_rate, host_rejected)`` with the shrunk failure rate of every host."""
    a, b = beta_prior(hosts)
    rate = (F.col("fails") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.select("host", rate.alias("host_rate"), (rate > threshold(a, b)).alias("host_rejected"))


def with_verdicts(judgements: DataFrame) -> DataFrame:
    """Adds ``host_rate``, ``host_rejected`` and ``kept`` to ``judgements(host, base_failed, failed, …)``."""
    verdicts = staged(host_verdicts(staged(host_counts(judgements), "hosts")), "verdicts").withColumnRenamed("host", "own")
    joined = judgements.join(verdicts, judgements["host"].eqNullSafe(verdicts["own"]), "left").drop("own")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def quality_report(docs: DataFrame, host: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: its signals, both verdicts and the host's shrunk failure rate."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    marks = staged(judged(signals(narrow, "text", ["doc_id", "host"])), "signals")
    return with_verdicts(marks).select("doc_id", *SIGNALS[:-1], "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"), "host_rejected")


def keep_good(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    rows = plain(docs)
    own, held = at(docs, host), rows.columns
    hosts = host_counts(judged(signals(rows.withColumn("host", F.col(own)), at(docs, text), ["host"])))
    verdicts = staged(host_verdicts(staged(hosts, "hosts")).filter("host_rejected").select("host"), "rejected")
    good = judged(signals(rows, at(docs, text), held)).filter(~F.col("base_failed"))
    return restored(good.join(verdicts, F.col(own).eqNullSafe(F.col("host")), "left_anti"), docs)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))
