"""Media columns by content-defined chunking: a rolling gear hash cuts, chunk digests are deduplicated
by joins, ordered chunk lists reconstruct the media, which a digest of the whole verifies.

A document's UTF-8 bytes, padded, are the samples of a WAV file: 8 bits, one channel. Pass one
cuts every file and keeps digests alone. A chunk of one file only is private, others are shared;
of the files that hold a shared chunk, the one of the smallest key stores it. Pass two moves each
distinct text once, compressed, to its key's partition, and writes its private chunks and the
shared ones that it stores, in a table bucketed by the key. Reading back, only shared chunks move.

Results at the edges: null text is empty, 576 bytes of padding; equal texts are one file; a null
doc_id is kept; repeated rows give equal rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucketed, materialize, mix64, read, scratch_path

BLOCK, PAD = 576, b"\xff"
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 16384, 11
SAMPLE_RATE = 8000
KEY_BYTES = 16
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload_of(raw: bytes) -> bytes:
    """Padded by bytes 255 to a positive multiple of BLOCK."""
    return raw + PAD * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def wav_of(payload: bytes) -> bytes:
    n = len(payload)
    u4, u2 = (lambda x: x.to_bytes(4, "little")), (lambda x: x.to_bytes(2, "little"))
    fmt = u2(1) + u2(1) + u4(SAMPLE_RATE) + u4(SAMPLE_RATE) + u2(1) + u2(8)
    return b"RIFF" + u4((36 + n + n % 2) & 0xFFFFFFFF) + b"WAVEfmt " + u4(16) + fmt + b"data" + u4(n & 0xFFFFFFFF) + payload + b"\0" * (n % 2)


def payload_from(wav: bytes) -> bytes:
    return wav[44 : 44 + int.from_bytes(wav[40:44], "little")]


def cuts(data: bytes) -> list[int]:
    """Ends of chunks. The gear hash of the last 32 bytes, by doubling: five shifts and adds for all positions."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for m in (1, 2, 4, 8, 16):
        h[m:] = h[m:] + (h[:-m] << np.uint32(m))
    ends, last = [], 0
    for at in (np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1).tolist():
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if at - last >= MIN_CHUNK:
            ends.append(at)
            last = at
    while len(data) - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    return ends if last == len(data) else [*ends, len(data)]


def chunks_of(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def key_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=KEY_BYTES).digest()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, keys, lists = [], [], []
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            wav = wav_of(payload_of(raw))
            n.append(len(raw)), keys.append(key_of(wav)), lists.append([key_of(x) for x in chunks_of(wav)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "media", "chunks"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([key_of(wav_of(payload_of(x))) for x in raw], pa.binary()), pa.array([squeeze.compress(x) for x in raw], pa.binary())], names=["media", "packed"])


_PIECE = pa.list_(pa.struct([("seq", pa.int32()), ("bytes", pa.binary())]))
_SHARED = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        private, shared = [], []
        for packed, foreign, stored in zip(*(batch.column(c).to_pylist() for c in ("packed", "foreign", "stored")), strict=True):
            parts, away = chunks_of(wav_of(payload_of(expand.decompress(packed)))), set(foreign or ())
            private.append([{"seq": i, "bytes": x} for i, x in enumerate(parts) if i not in away])
            shared.append([{"digest": key_of(parts[i]), "bytes": parts[i]} for i in stored or ()])
        yield pa.RecordBatch.from_arrays([batch.column("media"), pa.array(private, _PIECE), pa.array(shared, _SHARED)], names=["media", "private", "shared"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, private, foreign in zip(*(batch.column(c).to_pylist() for c in ("media", "private", "foreign")), strict=True):
            parts = sorted([(x["seq"], x["bytes"]) for x in [*(private or ()), *(foreign or ())]])
            wav = b"".join([x for _, x in parts])
            if key_of(wav) != key or [i for i, _ in parts] != list(range(len(parts))):
                raise ValueError("a reconstructed file differs from its digest")
            payload = payload_from(wav)
            samples = np.frombuffer(payload, np.uint8).astype(np.int64)
            feature = f"sum={samples.sum()};squares={(samples * samples).sum()};rises={(samples[1:] > samples[:-1]).sum()};chunks={len(parts)}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(wav), hashlib.sha256(wav).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("media"), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], names=["media", *FEATURES])


FEATURES = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_features(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) through the chunk store and back to (doc_id, n_bytes, FEATURES)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    listed = materialize(docs.mapInArrow(_cut, "doc_id long, n_bytes long, media binary, chunks array<binary>"), "chunks")
    refs = listed.select("media", "chunks").dropDuplicates(["media"]).select("media", F.posexplode("chunks").alias("seq", "digest"))
    refs = materialize(refs, "refs")
    held = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("media").alias("owner")).where("n > 1").select("digest", "owner")
    held = materialize(refs.join(held, "digest"), "shared")
    first = held.where("media = owner").groupBy("digest", "media").agg(F.min("seq").alias("seq")).select("media", F.col("seq").alias("stored_seq"))
    places = held.select("media", "seq").groupBy("media").agg(F.collect_list("seq").alias("foreign"))
    stored = first.groupBy("media").agg(F.collect_list("stored_seq").alias("stored"))

    packed = docs.mapInArrow(_pack, "media binary, packed binary").groupBy("media").agg(F.first("packed").alias("packed"))
    rows = packed.join(places, "media", "left").join(stored, "media", "left")
    rows = rows.mapInArrow(_store, "media binary, private array<struct<seq: int, bytes: binary>>, shared array<struct<digest: binary, bytes: binary>>")
    store = bucketed(rows, "media", scratch_path(spark, "store"), compression="zstd", **{"parquet.compression.codec.zstd.level": "9"})
    shared = store.select(F.explode("shared").alias("x")).select("x.digest", "x.bytes")
    away = held.select("media", "seq", "digest").join(shared, "digest").groupBy("media").agg(F.collect_list(F.struct("seq", "bytes")).alias("foreign"))
    whole = store.select("media", "private").join(away, "media", "left")
    found = whole.mapInArrow(_features, "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return listed.select("doc_id", "n_bytes", "media").join(found, "media").select("doc_id", "n_bytes", *FEATURES)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read(spark, sf_dir, "documents"))
