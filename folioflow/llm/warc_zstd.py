"""WARC archives as Zstandard files with one frame per record and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary; every record is one frame.
The writer turns rows into archives (path, content); the reader takes such rows, for instance
Spark's `binaryFile` source over `*.warc.zst`, finds the dictionary, decodes frame by frame and
checks each record: version line, required headers, block length, end mark, payload digest.

Cases: a null payload is empty. Payloads shorter than `least` bytes are always written in full.
Rows with the group's smallest id are responses, also if repeated; a null id is never the smallest.
A null url leaves its header out. Control characters in a url are percent-encoded. An empty table
gives no archive and no record. An archive without a dictionary frame is read without a
dictionary. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import by_bytes, stage, table

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")

#: Bytes that a decoder is given at a time.
STEP = 1 << 13

ARCHIVE = "path string, content binary"
RECORD = (
    "record_id string, record_type string, refers_to string, target_uri string, "
    "digest string, full_bytes long, payload binary"
)
FIRST_WORDS = (
    b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Target-URI: https://\r\n"
    b"WARC-Payload-Digest: sha256:\r\nContent-Type: application/http;msgtype=response\r\n"
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: \r\n\r\n"
)


def as_records(pages: DataFrame, id_column: str, url: str, payload: str, least: int = 100) -> DataFrame:
    """record_id, record_type, refers_to, target_uri, digest, full_bytes, payload of each row.

    Equal payloads share a digest; the smallest id of a digest with several rows is found with
    map-side aggregation over (digest, id), and only repeated digests are joined back. Adaptive
    execution splits a digest that very many rows share. Revisits drop their payload here.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(
        F.col(id_column).alias("_id"), F.col(url).alias("target_uri"), body.alias("payload")
    ).withColumns({"digest": F.sha2("payload", 256), "full_bytes": F.octet_length("payload").cast("long")})
    firsts = (
        rows.where(F.col("full_bytes") >= least)
        .groupBy("digest")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
        .where(F.col("_rows") > 1)
        .select("digest", "_first")
    )
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.join(firsts, "digest", "left").select(
        name("_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, name("_first")).alias("refers_to"),
        "target_uri",
        "digest",
        "full_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def sample_dictionary(records: DataFrame, rows: int = 256, size: int = 1 << 16) -> bytes:
    """A dictionary from at most `rows` responses of any partition; it changes sizes, never contents."""
    bodies = records.where(F.col("record_type") == "response").select(
        F.substring("payload", 1, size).alias("p")
    )
    samples = [FIRST_WORDS + bytes(r["p"]) for r in bodies.limit(rows).collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return FIRST_WORDS


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    if data[:4] == struct.pack("<I", FRAME):
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data)


def _value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _record(row: dict, date: str) -> bytes:
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['full_bytes']}\r\n\r\n"
    ).encode()
    block = http + (row["payload"] or b"")
    head = [f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_value(row['target_uri'])}")
    head.append(f"WARC-Payload-Digest: sha256:{row['digest']}")
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{row['refers_to']}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    records: DataFrame,
    dictionary: bytes,
    archive_bytes: int = 1 << 24,
    level: int = 3,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Archives of about `archive_bytes`, one or more per partition: path, content."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary), write_checksum=True)
        start = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def full():
            path = f"part-{part:06d}-{number:04d}.warc.zst"
            return pa.RecordBatch.from_pydict({"path": [path], "content": [start + b"".join(held)]})

        for batch in by_bytes(batches, "payload"):
            for row in batch.to_pylist():
                held.append(packer.compress(_record(row, date)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield full()
                    number, held, size = number + 1, [], 0
        if held:
            yield full()

    return records.mapInArrow(over, ARCHIVE)


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    view, at, packer = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"{len(view) - at} bytes left over at {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise ValueError(f"skippable frame at {at} is cut off")
            if at == 0 and magic == SKIPPABLE:
                packer = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(view[8 : 8 + size])))
            at += 8 + size
            continue
        # Fed in steps: what a step holds beyond the frame's end is copied back.
        one, parts, begin = packer.decompressobj(), [], at
        while not one.eof:
            if at >= len(view):
                raise ValueError(f"frame at {begin} is cut off")
            parts.append(one.decompress(view[at : at + STEP]))
            at = min(len(view), at + STEP)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """Headers, payload and checks of one record."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise ValueError(f"no WARC record: {record[:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"no header: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip().decode()
    for name in REQUIRED:
        if name not in fields:
            raise ValueError(f"{name.decode()} is missing")
    if not re.fullmatch(r"\d+", fields[b"content-length"]):
        raise ValueError(f"content-length {fields[b'content-length']!r}")
    length = int(fields[b"content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, content-length {length}")
    http, mark, payload = rest[:length].partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    if not mark or not size:
        raise ValueError("no HTTP headers in the block")
    digest = fields.get(b"warc-payload-digest", "").removeprefix("sha256:")
    kind, full = fields[b"warc-type"], int(size[1])
    if kind == "response" and (full != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {len(payload)} bytes does not match its headers")
    if kind == "revisit" and b"warc-refers-to" not in fields:
        raise ValueError("revisit without warc-refers-to")
    return {
        "record_id": fields[b"warc-record-id"].strip("<>"),
        "record_type": kind,
        "refers_to": fields.get(b"warc-refers-to", "").strip("<>") or None,
        "target_uri": fields.get(b"warc-target-uri"),
        "digest": digest or None,
        "full_bytes": full,
        "payload": payload if kind == "response" else None,
    }


def read_archives(archives: DataFrame, batch_bytes: int = 1 << 22) -> DataFrame:
    """Records of archives (path, content); a record that fails a check raises, naming its archive."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = {"full_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(c) for c in ("path", "content")), strict=True):
                held, size = [], 0
                try:
                    for record in frames(content.as_py()):
                        held.append(parse_record(record))
                        size += len(record)
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:
                    raise ValueError(f"{path.as_py()}: {e}") from e
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("path", "content").mapInArrow(over, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = as_records(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    bodies = table(spark, sf_dir, "pages").select(
        F.lit("response").alias("record_type"), F.col("html").cast("binary").alias("payload")
    )
    dictionary = sample_dictionary(bodies.where(F.col("payload").isNotNull()))
    archives = stage(write_archives(records, dictionary), "none")
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS bigint)")
    full = F.col("record_type") == "response"
    return read_archives(archives).select(
        number("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("full_bytes")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


OP10_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest
    FROM pages
), f AS (
    SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
