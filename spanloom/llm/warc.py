"""WARC archives: writing, and reading in splits.

Every record is a gzip member of its own. A reading task scans its byte range for the gzip magic,
accepts a candidate if it decodes to a WARC header, and owns the records that start in its range,
even if they end beyond it. Splits therefore need no index, and a file of any size is read by many
tasks. Payloads written here are UTF-8, in which the magic cannot occur, so a match inside a stored
block cannot be mistaken for a record.

Files are listed by Spark and opened by URI through pyarrow's file systems (local or shared mounts,
HDFS, S3, GCS). A file is written under a name of its task attempt and then moved into place, so a
repeated task replaces it with the same records.

Defined results: a null payload is empty; a null id is written as such and read back as null, and
is never referred to; rows repeated with the same id and payload are all responses; a null url is
left out; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import new_folder, opened, table

MAGIC = b"\x1f\x8b\x08"
#: Bytes read at once, and bytes of a split.
BLOCK, SPLIT = 1 << 20, 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode().rstrip("=")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}"]
    head += [f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packed.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, first, revisit)``: of equal payloads the smallest id is the response.

    Only payloads that occur more than once come back from the grouping, one row each; a payload
    with very many pages is split by the skew join.
    """
    pages = pages.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).drop("html").withColumn("same", F.sha2("payload", 256))
    large = F.length("payload") >= least_bytes
    firsts = pages.filter(large).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = pages.join(firsts, "same", "left")
    revisit = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "first", revisit.alias("revisit"))


def write_warc(records: DataFrame, folder: str) -> tuple[int, int]:
    """Write ``(page_id, url, payload, first, revisit)``, one file per partition; (records, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}.warc.gz"
        part = f"{base}/_{task.taskAttemptId()}.part"
        n = size = 0
        with system.open_output_stream(part, compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                    made = record(row[0], row[1], row[2] or b"", row[3], bool(row[4]))
                    out.write(made)
                    n, size = n + 1, size + len(made)
        if n:
            system.move(part, name)
        else:
            system.delete_file(part)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([size])], ["records", "bytes"])

    total = records.mapInArrow(run, "records long, bytes long").agg(F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return total[0], total[1]


class Window:
    """A file seen through a buffer that grows to the right and forgets on the left.

    What is forgotten is only marked until it is a whole block, so that small records are not copied
    over and over.
    """

    def __init__(self, file, at: int):
        self.file, self.base, self.data, self.ended = file, at, b"", False
        file.seek(at)

    def more(self) -> bool:
        if not self.ended:
            block = self.file.read(BLOCK)
            self.ended = not block
            self.data += block
        return not self.ended

    def forget(self, at: int) -> None:
        if at - self.base >= BLOCK:
            self.data = self.data[at - self.base :]
            self.base = at


def member(window: Window, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and end of the record in the gzip member at this offset; None if it is none."""
    unpack, text, place = zlib.decompressobj(31), b"", at - window.base
    checked = False
    try:
        while not unpack.eof:
            if place >= len(window.data) and not window.more():
                return None
            step = 4096 if not checked else 65_536
            text += unpack.decompress(window.data[place : place + step])
            place = min(place + step, len(window.data))
            if not checked and len(text) >= 7:
                if not text.startswith(b"WARC/1."):
                    return None
                checked = b"\r\n\r\n" in text
    except zlib.error:
        return None
    place -= len(unpack.unused_data)
    head, found, rest = text.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    if "WARC-Type" not in fields or not fields.get("Content-Length", "").isdigit() or int(fields["Content-Length"]) > len(rest):
        return None
    return fields, rest[: int(fields["Content-Length"])], window.base + place


def records_of(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records that start in [start, end) of an open file."""
    window, at = Window(file, start), start
    while at < end:
        found = window.data.find(MAGIC, at - window.base)
        if found < 0:
            # the last two bytes may begin a magic
            at = max(at, window.base + len(window.data) - 2)
            window.forget(at)
            if not window.more():
                return
            continue
        at = window.base + found
        if at >= end:
            return
        window.forget(at)
        if (got := member(window, at)) is None:
            at += 1
            continue
        yield at, got[0], got[1]
        at = got[2]


def read_warc(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """``(path, offset, type, record_id, url, date, digest, refers_to, http, payload)`` of all records."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    starts = listed.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "offset", "type", "record_id", "url", "date", "digest", "refers_to", "http", "payload"]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.binary(), pa.binary()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, name = opened(path)
                rows, size = [], 0
                with system.open_input_file(name) as file:
                    for at, head, block in records_of(file, start, start + split):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        rows.append((path, at, head["WARC-Type"], head.get("WARC-Record-ID"), head.get("WARC-Target-URI"), head.get("WARC-Date"), head.get("WARC-Payload-Digest"), head.get("WARC-Refers-To"), http, payload))
                        size += len(block)
                        if size > 4 * BLOCK:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    schema = "path string, offset long, type string, record_id string, url string, date string, digest string, refers_to string, http binary, payload binary"
    return starts.repartition(n, "path", "start").mapInArrow(run, schema)


def described(records: DataFrame) -> DataFrame:
    """Digest columns of page records: of a response from its payload, of a revisit from its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, own, digest, refers, http, payload in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if kind == "response":
                    size, digest = len(payload), base32(hashlib.sha1(payload).digest())
                else:
                    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), digest.removeprefix("sha1:")
                rows.append((page_of(own), size, digest, kind, page_of(refers)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    pages = records.filter(F.col("type").isin("response", "revisit")).select("type", "record_id", "digest", "refers_to", "http", "payload")
    return pages.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    written, _ = write_warc(with_roles(pages), folder)
    if not written:
        return described(spark.createDataFrame([], "type string, record_id string, digest string, refers_to string, http binary, payload binary"))
    return described(read_warc(spark, folder))
