"""Content-addressed WARC archive: payload bytes once, exact record headers apart.

``write_archive`` makes two tables in a folder that all executors share:

- ``payloads``: one row per distinct payload, keyed by its SHA-256, deflated;
- ``headers``: one row per record: the exact bytes of its WARC header (and of the
  HTTP header of a response), and the key of its payload.

Of records with equal payloads of at least ``least`` bytes the one with the
largest id is the response, the others are revisits that refer to it; smaller
ones are all responses. A digest is computed from the bytes before writing and
again from the stored bytes when reading; a difference is an error.
``records`` joins headers to payloads and rebuilds each record's exact bytes;
its id, type, target, length, digest and the record it refers to are parsed from
those bytes and held against the payload, and a difference is an error.
``read_back`` gives the same facts without the bytes.

Payloads move deflated: when writing, in one shuffle keyed by digest with map-side
combining, so that a payload that a third of all pages have is sent once per task;
when reading, in the join by digest, one row per distinct payload. Null payload:
empty. Null URL: empty target. Records that repeat an id each get a row; rows
with a null id are responses unless another row holds the payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import new_path

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # the profile that WARC 1.1 names


def _record_id(page_id: int | None) -> str:
    """A version 8 UUID (RFC 9562) that carries the 64-bit id in its free bits; its lowest bit marks a null id."""
    n = (page_id or 0) & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=n >> 16 << 80 | 8 << 76 | (n >> 4 & 0xFFF) << 64 | 2 << 62 | (n & 15) << 58 | (page_id is None))}>"


def _page_id(record_id: str) -> int | None:
    u = uuid.UUID(record_id[1:-1]).int
    n = u >> 80 << 16 | (u >> 64 & 0xFFF) << 4 | u >> 58 & 15
    return None if u & 1 else n - (n >> 63 << 64)


def _digested(deflate: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [b"" if t is None else t.encode() for t in part.column(2).to_pylist()]
                columns = [part.column(0), part.column(1), pa.array([hashlib.sha256(b).digest() for b in raw], pa.binary()),
                           pa.array([hashlib.sha1(b).digest() for b in raw], pa.binary()), pa.array([len(b) for b in raw], pa.int64())]
                names = ["id", "uri", "key", "sha1", "n_bytes"]
                if deflate:
                    columns, names = [columns[2], pa.array([zlib.compress(b, 1) for b in raw], pa.binary())], ["key", "deflated"]
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def _header(rec: dict) -> bytes:
    """The exact header bytes of one record, up to where a response's payload starts."""
    digest = "sha1:" + base64.b32encode(rec["sha1"]).decode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", rec["uri"] or "")
    lines = [("WARC-Type", "response" if rec["refers_to"] is None else "revisit"), ("WARC-Record-ID", _record_id(rec["id"])),
             ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {rec['n_bytes']}\r\n\r\n".encode()
    length = len(http)
    if rec["refers_to"] is None:
        length += rec["n_bytes"]
    else:
        lines += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(rec["refers_to"]))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(length))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + http


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_header(r) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.binary())], ["key", "header"])


def write_archive(pages: DataFrame, folder: str, id_column: str = "page_id", uri_column: str = "url", payload_column: str = "html",
                  least: int = LEAST) -> str:
    """Write the two tables of the archive under ``folder``; its name comes back."""
    rows = pages.select(F.col(id_column).cast("bigint"), F.col(uri_column), F.col(payload_column))
    stored = rows.mapInArrow(_digested(True), "key binary, deflated binary")
    stored.groupBy("key").agg(F.first("deflated").alias("deflated")).write.option("compression", "none").parquet(f"{folder}/payloads")
    facts = rows.mapInArrow(_digested(False), "id bigint, uri string, key binary, sha1 binary, n_bytes bigint")
    owner = facts.where(F.col("n_bytes") >= least).groupBy("key").agg(F.max("id").alias("owner"), F.count("*").alias("c")).where("c > 1")
    refers = F.when(F.col("owner").isNotNull() & ~F.col("id").eqNullSafe(F.col("owner")), F.col("owner"))
    typed = facts.join(owner, "key", "left").select("id", "uri", "key", "sha1", "n_bytes", refers.alias("refers_to"))
    typed.mapInArrow(_headers, "key binary, header binary").write.parquet(f"{folder}/headers")
    return folder


def _fields(block: bytes) -> dict[str, str]:
    """The named fields of a header block, behind its first line."""
    return dict(line.decode().split(": ", 1) for line in block.split(b"\r\n")[1:])


def parse_record(record: bytes, payload: bytes) -> tuple[int | None, str, int | None, str]:
    """(id, type, id referred to, payload's SHA-1 in hex) read from a record's bytes, checked against its full payload."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    kind, block = fields["WARC-Type"], block[:-4]  # two line ends close a record
    http, _, body = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    sound = (record.endswith(b"\r\n\r\n") and len(block) == int(fields["Content-Length"]) and digest == hashlib.sha1(payload).digest()
             and int(_fields(http)["Content-Length"]) == len(payload) and body == (payload if kind == "response" else b""))
    if not sound:
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't agree with its payload")
    refers = fields.get("WARC-Refers-To")
    return _page_id(fields["WARC-Record-ID"]), kind, refers and _page_id(refers), digest.hex()


FACTS = "id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _read(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for key, header, deflated in zip(*(part.column(c).to_pylist() for c in ("key", "header", "deflated")), strict=True):
                    payload = zlib.decompress(deflated)
                    if hashlib.sha256(payload).digest() != key:
                        raise ValueError(f"payload {key.hex()} was altered")
                    body = payload if header.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") else b""
                    record = b"".join((header, body, b"\r\n\r\n"))
                    page, kind, refers, digest = parse_record(record, payload)
                    rows.append((page, len(payload), digest, kind, refers, *((record, payload) if whole else ())))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())[:7 if whole else 5]
                names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record", "payload"][:len(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
    return run


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    headers = spark.read.parquet(f"{folder}/headers").select("key", "header")
    return headers.join(spark.read.parquet(f"{folder}/payloads").select("key", "deflated"), "key")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """FACTS of every record with its exact bytes (``record``) and its full ``payload`` (a revisit's from the response)."""
    return _stored(spark, folder).mapInArrow(_read(True), FACTS + ", record binary, payload binary")


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """FACTS of every record, from the same rebuilt bytes, which stay in the tasks."""
    return _stored(spark, folder).mapInArrow(_read(False), FACTS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written to an archive in the shared folder and read back."""
    folder = write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc"))
    return read_back(spark, folder).withColumnRenamed("id", "page_id")
