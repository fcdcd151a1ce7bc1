import base64
import hashlib
import io
import zlib

import pytest

from spanloom.llm import warc
from spanloom.llm.common import new_folder


def expected(rows):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        first, payload = min(groups[html or ""]), (html or "").encode()
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out)


def write(spark, path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.mode("overwrite").parquet(f"{path}/pages.parquet")


def test_digests(spark, tmp_path):
    rows = [(1, "http://a/é b", None), (2, None, ""), (3, "x", "<p>hi</p>"), (4, "x", "<p>hi</p>"), (5, "x\r\ny", "é" * 1_500_000), (-7, "q", "<p>hi</p>")]
    write(spark, tmp_path, rows)
    assert sorted(map(tuple, warc.op1_warc(spark, str(tmp_path)).collect())) == expected(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op1_warc(spark, "/root/testdata/sf0.001").collect())) == expected(rows)


def test_empty_table_and_repeated_rows(spark, tmp_path):
    write(spark, tmp_path / "none", [(1, "a", "b")][:0])
    assert warc.op1_warc(spark, str(tmp_path / "none")).collect() == []
    write(spark, tmp_path / "twice", [(1, "a", "b"), (1, "a", "b"), (None, "c", "d")])
    got = sorted(map(tuple, warc.op1_warc(spark, str(tmp_path / "twice")).collect()), key=repr)
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (1, "response", None), (None, "response", None)]


@pytest.mark.parametrize("split", [997, 20_000, 1 << 25])
def test_splits_lose_and_repeat_nothing(spark, split):
    folder = new_folder(spark, "warc")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    n, _ = warc.write_warc(warc.with_roles(pages.select("page_id", "url", "html")), folder)
    read = warc.read_warc(spark, folder, split)
    assert n == pages.count() == read.count() == read.select("record_id").distinct().count()


def test_false_magic_and_foreign_members():
    good = warc.record(1, "u", b"x" * 50, None, False)
    foreign = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = foreign.compress(b"hello, no record") + foreign.flush()
    data = b"junk" + warc.MAGIC + b"\x00\x00" + good + other + good + b"\x1f\x8b"
    found = list(warc.records_of(io.BytesIO(data), 0, len(data)))
    assert [f[0] for f in found] == [9, 9 + len(good) + len(other)]
    halves = [list(warc.records_of(io.BytesIO(data), a, b)) for a, b in ((0, 30), (30, len(data)))]
    assert [x[0] for h in halves for x in h] == [f[0] for f in found]
