"""WARC archives: writing with segmented records, reading with segment reassembly.

Each page becomes an HTTP response record whose body has chunked transfer framing, or a
revisit record when a page with the same payload and a larger id exists. A block over
``SEGMENT_BYTES`` is split: a first segment and ``continuation`` records that name it.
Reading parses every archive by its content lengths, groups the segments by origin,
orders them by number, verifies the total length and the digest, and decodes the framing.

Archives are plain text files for Spark's writer, since each record ends in a line feed
that the writer adds; so they go to any store that Spark can write.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.shared import shared_folder, stored

SEGMENT_BYTES = 16 * 1024
CHUNK_BYTES = 4096
#: An archive is read whole by one task: it has at most so many bytes, at this many for the headers of a record.
ARCHIVE_BYTES = 64 * 1024 * 1024
HEAD_BYTES = 1024
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_SCHEMA = "record_id string, page_id long, record_type string, segment int, total_length long, refers_to long, digest string, payload binary, problem string"


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- writing -------------------------------------------------------------------------


def _chunked(payload: bytes) -> bytes:
    parts = []
    for at in range(0, len(payload), CHUNK_BYTES):
        part = payload[at : at + CHUNK_BYTES]
        parts += (b"%x\r\n" % len(part), part, b"\r\n")
    return b"".join((*parts, b"0\r\n\r\n"))


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """Without the last line feed."""
    lines = [f"{k}: {v}".encode() for k, v in headers if v is not None]
    return b"\r\n".join((VERSION, *lines, b"Content-Length: %d" % len(block), b"", block, b"\r"))


def page_records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, mark: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page; ``mark`` tells rows with the same page_id apart."""
    own = f"<urn:page:{'' if page_id is None else page_id}:{mark}>"
    uri = "".join(c for c in url or "" if c > " ") or None
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    digest = ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, digest, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE), kind], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    block = HTTP_HEAD + _chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, digest, kind], block)
        return
    starts = range(0, len(block), segment_bytes)
    for number, at in enumerate(starts, 1):
        part = block[at : at + segment_bytes]
        if number == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, digest, ("WARC-Segment-Number", 1), kind], part)
        else:
            yield _record(
                [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{number}>"), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", number),
                 ("WARC-Segment-Total-Length", len(block) if number == len(starts) else None)],
                part,
            )


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, refers_to``: null for the page with the largest id among equal payloads.

    Only the digests of payloads that occur more than once are kept as a table; of rows with the
    same id and payload each is a response. A page without an id is a response of its own.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha1("payload"))
    repeated = stored(rows.groupBy("key").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1 and largest is not null").drop("n"), "repeated-payloads")
    return rows.join(repeated, "key", "left").select("page_id", "url", "payload", F.when(F.col("page_id") != F.col("largest"), F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Null html is an empty payload; ids may be null or repeated."""

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, out = batch.slice(at, 500), []
                for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                    out.extend(page_records(*row, mark=f"{task}-{count}", segment_bytes=segment_bytes))
                    count += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    records = with_revisits(pages).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // (segment_bytes + HEAD_BYTES))).text(path)


# ---- reading -------------------------------------------------------------------------


def parse_records(archive: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers (lower-case names) and block of each record. Raises ValueError on a broken record."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        stop = archive.find(b"\r\n\r\n", at)
        if stop < 0 or not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = archive[at:stop].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin = stop + 4
        end = begin + int(headers["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield headers, view[begin:end]
        at = end + 4


def dechunk(body: bytes) -> bytes:
    """The payload behind chunked transfer framing."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("chunk size is missing")
        n = int(body[at:stop].split(b";")[0], 16)
        if n == 0:
            return b"".join(parts)
        part = body[stop + 2 : stop + 2 + n]
        if len(part) < n or body[stop + 2 + n : stop + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(part)
        at = stop + 4 + n


def http_payload(block: bytes) -> bytes:
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("no HTTP head")
    return dechunk(body) if b"transfer-encoding: chunked" in head.lower() else body


def _page(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").split(":")
    return int(value[2]) if len(value) > 2 and value[2].lstrip("-").isdigit() else None


def _row(headers: dict[str, str], block: memoryview, finish: bool) -> tuple:
    origin = headers.get("warc-segment-origin-id") or headers["warc-record-id"]
    segment, total = headers.get("warc-segment-number"), headers.get("warc-segment-total-length")
    payload, problem, kind = bytes(block), None, headers.get("warc-type")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if finish and kind == "response":
        payload, problem = _finished(payload, digest)
    return origin, _page(origin), kind, int(segment) if segment else None, int(total) if total else None, _page(headers.get("warc-refers-to")), digest, payload, problem


def _finished(block: bytes, digest: str | None) -> tuple[bytes | None, str | None]:
    try:
        payload = http_payload(block)
    except ValueError as e:
        return None, str(e)
    return (payload, None) if digest in (None, payload_digest(payload)) else (payload, "the payload digest differs")


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"record_id": pa.string(), "page_id": pa.int64(), "record_type": pa.string(), "segment": pa.int32(), "total_length": pa.int64(), "refers_to": pa.int64(), "digest": pa.string(), "payload": pa.binary(), "problem": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], names=list(kinds))


def _batched(rows: Iterator[tuple], most: int = 1000, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[7] or b"")
        if len(out) >= most or held >= size:
            yield _arrow(out)
            out, held = [], 0
    if out:
        yield _arrow(out)


def _records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """Whole records with their payload, or the segments of the others with their raw blocks."""

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    for headers, block in parse_records(batch.column("content")[i].as_py()):
                        if ("warc-segment-number" in headers) == segmented:
                            yield _row(headers, block, not segmented)

        yield from _batched(rows())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ_SCHEMA)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row per origin. Segments of a record are neighbours in order; one record at a time is held.

    ``problem`` tells of a missing or repeated segment, a wrong total length, broken framing or another
    digest; such a record is returned, with what could be decoded.
    """

    def run(batches):
        def joined(group: list[tuple]) -> tuple:
            first = group[0]
            numbers, block = [r[3] for r in group], b"".join(r[7] for r in group)
            total = group[-1][4]
            if numbers != list(range(1, len(group) + 1)):
                return (*first[:4], total, *first[5:7], None, "segments are missing or repeated")
            if total != len(block):
                return (*first[:4], total, *first[5:7], None, "the total length differs")
            payload, problem = _finished(block, first[6])
            return (*first[:4], total, *first[5:7], payload, problem)

        def rows():
            group: list[tuple] = []
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if group and row[0] != group[0][0]:
                        yield joined(group)
                        group = []
                    group.append(row)
            if group:
                yield joined(group)

        yield from _batched(rows())

    return segments.repartition("record_id").sortWithinPartitions("record_id", "segment").mapInArrow(run, READ_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every response and revisit record of the archives; only segmented records are shuffled."""
    return _records(spark, path, segmented=False).unionByName(reassemble(_records(spark, path, segmented=True)))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder, read the archives back and describe each page.

    A revisit has no payload of its own: its length comes from the response with the same digest.
    """
    spark = pages.sparkSession
    path = shared_folder(spark, "warc")
    write_archives(pages, path)
    records = read_archives(spark, path).filter("record_type in ('response', 'revisit')").select(
        "page_id", "record_type", "refers_to", F.length("payload").cast("long").alias("own_bytes"), F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(
            F.when(F.col("problem").isNull(), F.col("digest"))).alias("payload_digest"),
    )
    records = stored(records, "warc-records")
    revisits = records.filter("record_type = 'revisit'")
    targets = records.filter("record_type = 'response'").join(revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct(), ["page_id", "payload_digest"], "left_semi")
    targets = targets.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own_bytes").alias("full_bytes"))
    found = revisits.join(targets, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.filter("record_type = 'response'").withColumnRenamed("own_bytes", "payload_bytes").select(columns).unionByName(
        found.withColumnRenamed("full_bytes", "payload_bytes").select(columns)
    )
