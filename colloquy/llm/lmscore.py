"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to documents' n-grams, summed per document.

The score of a word is S(w | context) = c(context w) / c(context) where the n-gram was seen, else
0.4 S(w | shorter context); a word alone has c(w) / N, a word never seen 1 / (N + 1). All counts
cover the whole table less the document that is scored (its row), so no text vouches for itself.

Documents are dealt into blocks by a hash. A block explodes into its distinct n-grams, sorted by
64-bit hash and packed, one row for each bucket of the hash's range. A bucket holds the count table
of its range: it adds up the blocks' counts and joins the totals to the rows that asked, which go
back to their blocks, where scores are summed per document. So an n-gram travels once a block, not
once a document: a frequent one adds a row's entry for each block, and blocks grow with the input
up to BLOCK_BYTES[1]. Texts, n-grams and counts travel as bytes squeezed by zstd. An n-gram is its
hash, of as many bits as the corpus asks for: SPARE_BITS more than the logarithm of its n-grams, 64
at most. Of n n-grams about n / 2^28 pairs share a hash then, and a count: one of 10^8 n-grams, some
60 at 30 GB (more where 64 bits are the limit, beyond about 10^11 n-grams); none is dropped.

Results at the edges: null or blank text has no words, score 0 and a null mean; a text shorter than
the order uses shorter n-grams; a table of one document scores every word 1 / (N + 1) with N = 0,
that is 0 in logarithm, and 0.4 for each shortening; repeated rows count and are scored as rows; a
null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, read, windows

ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a block: a BLOCKS-th of the input between these bounds, which bound a task's memory.
BLOCKS, BLOCK_BYTES = 256, (64 << 10, 16 << 20)
#: N-grams in a bucket, about, before blocks merge theirs.
BUCKET_GRAMS = 500_000
#: Bits of a hash beyond the logarithm of all n-grams.
SPARE_BITS = 27
#: Logarithms are rounded to a millionth before they are added, so sums don't depend on their order.
UNIT = 1_000_000

_BLOCKED = "block long, ids array<long>, sizes array<int>, texts binary"
_PACKED = "block long, bucket int, n int, grams binary, counts binary"
_TOTALS = "block long, bucket int, n int, totals binary"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backed_off", pa.int64()), ("log_score_micro", pa.int64())])


def squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.compress(raw, 3)


def expand(packed: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(packed)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers byte plane by byte plane, without the upper planes that are zero, squeezed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = int(values.max()).bit_length() if len(values) else 0
    return squeeze(np.ascontiguousarray(planes[: -(-used // 8)]).tobytes())


def unpack(packed: bytes, n: int) -> np.ndarray:
    out, raw = np.zeros((n, 8), np.uint8), expand(packed)
    if raw:
        planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<u8")


def grams_of(text: bytes, order: int, bits: int, memo: WordHashes) -> list[np.ndarray]:
    """Hashes of the n-grams of each length up to order, in text order."""
    h = memo.of(text.split())
    return [windows(h, k) >> np.uint64(64 - bits) if len(h) >= k else h[:0] for k in range(1, order + 1)]


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, block) to one row for each block in a batch."""
    for batch in batches:
        order = np.argsort(batch.column("block").to_numpy(), kind="stable")
        batch = batch.take(pa.array(order))
        names, starts = np.unique(batch.column("block").to_numpy(), return_index=True)
        rows = []
        for block, a, b in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text")[a:b].to_pylist()]
            rows.append((block, batch.column("doc_id")[a:b].to_pylist(), list(map(len, raw)), squeeze(b"".join(raw))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["block", "ids", "sizes", "texts"])


def _unblock(table: pa.Table) -> tuple[list[int | None], Iterator[bytes]]:
    """Ids and texts of a block's rows."""

    def texts() -> Iterator[bytes]:
        for sizes, packed in zip(table.column("sizes"), table.column("texts"), strict=True):
            raw, at = expand(packed.as_py()), 0
            for n in sizes.as_py():
                yield raw[at : at + n]
                at += n

    return [i for x in table.column("ids") for i in x.as_py()], texts()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes = n_words = 0
        for text in batch.column("text"):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            n_bytes, n_words = n_bytes + len(raw), n_words + len(raw.split())
        yield pa.RecordBatch.from_arrays([pa.array([n_bytes]), pa.array([n_words])], names=["bytes", "words"])


def _exploder(order: int, bits: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def explode(table: pa.Table) -> pa.Table:
        memo, found = WordHashes(), [np.empty(0, np.uint64)]
        for text in _unblock(table)[1]:
            found += grams_of(text, order, bits, memo)
        grams, counts = np.unique(np.concatenate(found), return_counts=True)
        bucket = _bucket_of(grams << np.uint64(64 - bits), buckets)
        names, starts = np.unique(bucket, return_index=True)
        ends = [*starts[1:].tolist(), len(grams)]
        rows = [(grams[a:b], counts[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
        block = table.column("block")[0].as_py()
        packed = [pack(np.diff(g, prepend=np.uint64(0))) for g, _ in rows]
        columns = [
            pa.array([block] * len(rows), pa.int64()),
            pa.array(names, pa.int32()),
            pa.array([len(g) for g, _ in rows], pa.int32()),
            pa.array(packed, pa.binary()),
            pa.array([pack(c.astype(np.uint64)) for _, c in rows], pa.binary()),
        ]
        return pa.Table.from_arrays(columns, names=["block", "bucket", "n", "grams", "counts"])

    return explode


def _bucket_of(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash, so a sorted block falls into runs."""
    return (((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _count(table: pa.Table) -> pa.Table:
    """The count table of one bucket, joined to the rows that asked."""
    sizes = table.column("n").to_pylist()
    grams = np.concatenate([np.cumsum(unpack(x, n), dtype=np.uint64) for x, n in zip(table.column("grams").to_pylist(), sizes, strict=True)])
    counts = np.concatenate([unpack(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
    _, place = np.unique(grams, return_inverse=True)
    totals = np.zeros(int(place.max()) + 1, np.uint64)
    np.add.at(totals, place, counts)
    parts = np.split(totals[place], np.cumsum(sizes)[:-1])
    packed = pa.array([pack(x) for x in parts], pa.binary())
    return pa.Table.from_arrays([table.column("block"), table.column("bucket"), table.column("n"), packed], names=["block", "bucket", "n", "totals"])


def logs_of(counts: list[np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the words' scores and whether a word was backed off; counts[k - 1] has the counts of the k-grams."""
    alone = counts[0].astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(alone > 0, np.log(alone / total), -np.log(total + 1.0))
        short = np.zeros(len(out), bool)
        for k in range(2, len(counts) + 1):
            whole, context = counts[k - 1].astype(float), counts[k - 2][: len(counts[k - 1])].astype(float)
            seen = whole > 0
            out[k - 1 :] = np.where(seen, np.log(whole / context), np.log(BACKOFF) + out[k - 1 :])
            short[k - 1 :] = ~seen
    return out, short


def _scorer(order: int, bits: int, total: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(docs: pa.Table, totals: pa.Table) -> pa.Table:
        memo, (ids, texts) = WordHashes(), _unblock(docs)
        found = [grams_of(x, order, bits, memo) for x in texts]
        grams, place = np.unique(np.concatenate([np.empty(0, np.uint64), *(g for doc in found for g in doc)]), return_inverse=True)
        back = sorted(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist(), totals.column("n").to_pylist(), strict=True))
        every = np.concatenate([np.empty(0, np.uint64), *(unpack(x, n) for _, x, n in back)]).astype(np.int64)
        if len(every) != len(grams):
            raise ValueError(f"{len(grams)} n-grams asked, {len(every)} counts came back")
        n_words, n_short, logs, at = [], [], [], 0
        for doc in found:
            counts = []
            for g in doc:
                here = place[at : at + len(g)]
                at += len(g)
                _, inverse, own = np.unique(here, return_inverse=True, return_counts=True)
                counts.append(every[here] - own[inverse])
            value, short = logs_of(counts, total - len(doc[0]))
            n_words.append(len(doc[0])), n_short.append(int(short.sum()))
            logs.append(int(np.rint(value * UNIT).astype(np.int64).sum()))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (ids, n_words, n_short, logs)], schema=_SCORES)

    return score


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_words, n_backed_off, log_score_micro, mean_log_score), one row per row."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    size = docs.select("text").mapInArrow(_sizes, "bytes long, words long").agg(F.sum("bytes").alias("bytes"), F.sum("words").alias("words")).first()
    n_bytes, total = size["bytes"] or 0, size["words"] or 0
    per_block = min(max(n_bytes // BLOCKS, BLOCK_BYTES[0]), BLOCK_BYTES[1])
    blocks, buckets = n_bytes // per_block + 1, order * total // BUCKET_GRAMS + 1
    bits = min((order * total + 1).bit_length() + SPARE_BITS, 64)
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))).mapInArrow(_block, _BLOCKED)
    packed = blocked.groupBy("block").applyInArrow(_exploder(order, bits, buckets), _PACKED)
    totals = packed.groupBy("bucket").applyInArrow(_count, _TOTALS)
    scored = blocked.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_scorer(order, bits, total), "doc_id long, n_words long, n_backed_off long, log_score_micro long")
    mean = F.when(F.col("n_words") > 0, F.col("log_score_micro") / F.lit(UNIT) / F.col("n_words"))
    return scored.withColumn("mean_log_score", mean)


def op3_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
