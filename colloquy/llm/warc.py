"""WARC as a content-addressed archive.

Two tables in the shared folder make an archive: payloads holds each distinct payload once, packed
by zstd, under its SHA-256; records holds every record's exact header bytes. A task sends each
payload once, the rest is pre-aggregated by digest before and after one shuffle, so a payload of a
third of all pages makes one row a task. Reading back, payload bytes join response records alone,
in place, since payloads are bucketed by digest; revisits have no bytes and join a narrow table of
facts (digest, length, SHA-1). Every payload is hashed again on either way.

Results at the edges: null html is an empty payload, archived like any other; a null url leaves
WARC-Target-URI out; line breaks in a url are percent-encoded; repeated rows of one page_id are
records of their own, all response if the page_id is the smallest of its payload; a null page_id
sorts last and refers to the smallest id, and is response where its payload has no id at all; an
empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, read, scratch_path

DATE = "2024-01-01T00:00:00Z"
#: Digests that a task remembers having sent; it forgets all when full, which changes no result.
SENT = 1 << 18
_PAYLOAD = "digest binary, packed binary"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record binary"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()),
                pa.array([len(x) for x in raw], pa.int64()),
                pa.array([base64.b32encode(hashlib.sha1(x).digest()).decode() for x in raw], pa.string()),
            ],
            names=["page_id", "url", "digest", "length", "sha1"],
        )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload once a task, as (digest, packed)."""
    import zstandard

    squeeze, sent = zstandard.ZstdCompressor(level=3), set()
    for batch in batches:
        digests, packed = [], []
        for html in batch.column("html").to_pylist():
            raw = (html or "").encode("utf-8", "surrogatepass")
            digest = hashlib.sha256(raw).digest()
            if digest not in sent:
                if len(sent) >= SENT:
                    sent.clear()
                sent.add(digest)
                digests.append(digest), packed.append(squeeze.compress(raw))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "packed"])


def record_headers(page_id: int | None, first_id: int | None, url: str | None, length: int, sha1: str) -> bytes:
    """All bytes of a record before its payload: WARC header, blank line, HTTP header, blank line."""
    response = page_id == first_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if not response:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first_id}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (length if response else 0)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + http


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("page_id", "first_id", "url", "length", "sha1"))
        headers = [record_headers(*x) for x in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("response"), pa.array(headers, pa.binary())], names=["digest", "response", "header"])


def archive(pages: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write path/records and path/payloads; gives both tables, as read_archive takes them."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    pages.mapInArrow(_digests, "page_id long, url string, digest binary, length long, sha1 string").write.option("compression", "zstd").parquet(f"{path}/marked")
    marked = spark.read.parquet(f"{path}/marked")
    # written, so that the join below starts from two plain tables, whose hot digests Spark can split
    marked.groupBy("digest").agg(F.min("page_id").alias("first_id")).write.option("compression", "zstd").parquet(f"{path}/first")
    records = marked.join(spark.read.parquet(f"{path}/first"), "digest").withColumn("response", F.col("page_id").eqNullSafe(F.col("first_id")))
    records.mapInArrow(_headers, "digest binary, response boolean, header binary").write.option("compression", "zstd").parquet(f"{path}/records")
    packed = pages.select("html").mapInArrow(_pack, _PAYLOAD).groupBy("digest").agg(F.first("packed").alias("packed"))
    return spark.read.parquet(f"{path}/records"), bucketed(packed, "digest", f"{path}/payloads", compression="none")


def _parsed(rows: list[tuple[bytes, int, str, bytes]]) -> pa.RecordBatch:
    """(header, payload length, SHA-1, body) of records to their facts and whole bytes."""
    out = []
    for header, length, sha1, body in rows:
        fields = dict(x.split(": ", 1) for x in header.split(b"\r\n\r\n")[0].decode("utf-8", "surrogatepass").split("\r\n")[1:])
        if fields["WARC-Payload-Digest"] != f"sha1:{sha1}":
            raise ValueError("a record's payload differs from its header")
        page, to = fields["WARC-Record-ID"][10:-1], fields.get("WARC-Refers-To", "")[10:-1]
        out.append((int(page) if page else None, length, sha1, fields["WARC-Type"], int(to) if to else None, header + body + b"\r\n\r\n"))
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record"])


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, str]]:
    """The payloads of a batch with length and SHA-1, each hashed against the digest that it is stored under."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for digest, packed in zip(batch.column("digest").to_pylist(), batch.column("packed").to_pylist(), strict=True):
        payload = expand.decompress(packed)
        if hashlib.sha256(payload).digest() != digest:
            raise ValueError("a stored payload differs from its digest")
        yield payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(n, sha1) for _, n, sha1 in _opened(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], names=["digest", "length", "sha1"])


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _parsed([(header, n, sha1, payload) for header, (payload, n, sha1) in zip(batch.column("header").to_pylist(), _opened(batch), strict=True)])


def _revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _parsed([(*x, b"") for x in zip(*(batch.column(c).to_pylist() for c in ("header", "length", "sha1")), strict=True)])


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record, its bytes as they were, with what its header and its verified payload say.

    Payloads may be what archive gave or path/payloads read as Parquet; the latter moves them once more.
    """
    responses = records.where("response").select("digest", "header").join(payloads, "digest").mapInArrow(_responses, _RECORD)
    revisits = records.where("not response").select("digest", "header").join(payloads.mapInArrow(_facts, "digest binary, length long, sha1 string"), "digest")
    return responses.unionByName(revisits.select("header", "length", "sha1").mapInArrow(_revisits, _RECORD))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = archive(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archive(*stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("record").alias("record_bytes"))
