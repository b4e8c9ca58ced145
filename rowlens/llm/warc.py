"""WARC archives whose records are single Zstandard frames with a dictionary.

An archive file starts with a skippable frame (magic ``5D 2A 4D 18``) that holds
a dictionary trained on the first records of the archive; each record follows as
one frame compressed with it, so that any record can be read by its offset.
Frames are gathered in pieces of about ROW_BYTES, and between pieces stands an
empty skippable frame. That frame is eight ASCII bytes, so Spark's own text
writer, with the frame as its line separator, writes the files: the commit
protocol, retries and any Hadoop file system come with it. After a set number of
pieces it starts a new file, and so does the dictionary: an archive has one, and
is small enough to be read whole by a task, however large a partition is.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed_shuffles

#: An empty skippable frame: magic 0x184D2A50, size 0. Readers pass over it.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
#: Bytes of a piece of an archive, and of an archive, after which the next begins.
ROW_BYTES, ARCHIVE_BYTES = 1 << 20, 64 << 20

RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """One row per page with the type of its record.

    Among pages with equal payloads of at least ``min_revisit_bytes`` bytes the
    smallest page_id is the response and the others are revisits of it. A null
    html is an empty payload. Rows that share the smallest page_id are all
    responses; a null page_id is never the response of another page, and equal
    pages that all lack an id are all responses.

    The group's smallest id is a map-side combined minimum; the join back is a
    plain equi-join, whose hot digests adaptive execution splits.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    firsts = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first_id IS NOT NULL").drop("n")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    if min_revisit_bytes:
        revisit &= F.octet_length("payload") >= min_revisit_bytes
    return rows.join(firsts, "sha", "left").select("page_id", "url", "payload", "sha", F.when(revisit, F.col("first_id")).alias("refers_to"))


def record_bytes(page_id, url, payload: bytes, sha: bytes, refers_to, date: str) -> bytes:
    """A WARC/1.1 record: a response with its HTTP message, or a revisit without payload."""
    digest = base64.b32encode(sha).decode()
    target = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        body = http
    else:
        body = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def train_dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; with too few samples, their own bytes as raw content."""
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, max(1024, total // 8)), samples, k=512, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive_rows(records: Iterator[bytes], rows_per_archive: int, row_bytes: int, sample_bytes: int, dict_bytes: int, level: int) -> Iterator[bytes]:
    """The archives of some records, in pieces; every ``rows_per_archive``-th piece starts one with its dictionary.

    A dictionary is trained on the first ``sample_bytes`` of the archive's records,
    so memory holds that many bytes of records and one piece.
    """
    records = iter(records)
    more = next(records, None)
    while more is not None:
        held, size = [], 0
        while more is not None and (not held or size + len(more) <= sample_bytes):
            held.append(more)
            size += len(more)
            more = next(records, None)
        trained = train_dictionary(held, dict_bytes)
        own = trained.as_bytes()
        pack = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
        row = bytearray(struct.pack("<II", DICT_MAGIC, len(own)) + own)
        rows = 0
        held.reverse()
        while rows < rows_per_archive and (held or more is not None):
            if held:
                row += pack.compress(held.pop())
            else:
                row += pack.compress(more)
                more = next(records, None)
            if len(row) >= row_bytes:
                yield bytes(row)
                row.clear()
                rows += 1
        if row:
            yield bytes(row)
        if held:  # pieces smaller than the sample
            records, more = itertools.chain(reversed(held), [] if more is None else [more], records), None
            more = next(records, None)


def write_archives(records: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = 1 << 20, dict_bytes: int = 32 << 10, level: int = 3, date: str = "1970-01-01T00:00:00Z", row_bytes: int = ROW_BYTES) -> None:
    """Write the rows of ``plan_records`` as archive files of about ``archive_bytes`` in ``path``, one or more per partition."""
    per_file = max(1, archive_bytes // row_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records_() -> Iterator[bytes]:
            for b in batches:
                for i in range(b.num_rows):
                    yield record_bytes(*(b.column(c)[i].as_py() for c in ("page_id", "url", "payload", "sha", "refers_to")), date)

        for row in archive_rows(records_(), per_file, row_bytes, sample_bytes, dict_bytes, level):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["row"])

    with freed_shuffles(records.sparkSession):
        rows = records.mapInArrow(run, "row binary").select(F.col("row").cast("string").alias("value"))
        rows.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", per_file).text(path)


def frame_end(buf: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its block headers."""
    flags = buf[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[flags >> 6])
    last = 0
    while not last:
        head = int.from_bytes(buf[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * (flags >> 2 & 1)


def parse_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    buf, at, unpack = memoryview(content), 0, None
    while at < len(buf):
        magic, size = struct.unpack_from("<II", buf, at)
        if magic == DICT_MAGIC:
            own = bytes(buf[at + 8 : at + 8 + size])
            kind = zstandard.DICT_TYPE_FULLDICT if own[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own, dict_type=kind))
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
        elif magic == ZSTD_MAGIC and unpack:
            end = frame_end(buf, at)
            yield unpack.decompress(buf[at:end])
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def parse_record(record: bytes) -> tuple:
    """A row of RECORD_SCHEMA; the payload of a response must have the digest its header gives."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    body = rest[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if fields["WARC-Type"] == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    length = int(fields["X-Payload-Length"]) if payload is None else len(payload)
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To")), payload


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in ``path``: a row of RECORD_SCHEMA each (payload null for revisits).

    Every record is decompressed and checked; ``payloads=False`` leaves them out of the rows.
    A task holds one archive, which the writer bounds, and the records of some bytes.
    """
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    keep = len(names) - (not payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True))[:keep], types[:keep], strict=True)], names[:keep])
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for r in parse_archive(b.column(0)[i].as_py()):
                    rows.append(parse_record(r)[:keep])
                    size += len(r)
                    if len(rows) >= 1000 or size >= 4 << 20:
                        yield make(rows)
                        rows, size = [], 0
                if rows:
                    yield make(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(RECORD_SCHEMA.split(", ")[:keep]))
