"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Signature: one random bijection scatters shingles over the 32-bit ring, a second one, shifted
by k around the ring, gives coordinate k: min over shingles of second(first(x) + k). 128
coordinates in 32 bands of 4 miss a pair of Jaccard 0.75 with probability 5e-6.

No bucket is expanded into all pairs. Each bucket's members are compared with two leaders. Buckets
whose members still lie in several components stay open: there members are compared with two more
leaders, chosen by hash so that a document meets others in each bucket, and at last those outside the
bucket's main component with the members of other components. In open buckets the join itself drops
pairs that can't be linked, by sizes and by parities: shingles fall into cells by hash, and a cell
whose counts in two sets differ in parity holds a shingle of one alone, so the cells that differ are
no more than such shingles, which in a linked pair are at most a seventh of both sizes together. That
is a proof, not an estimate: no link is lost behind banding, and pairs that merely share a passage
never leave the join. Two members of one component need no comparison.
Buckets, hubs and classes that hold a large share of rows are split over tasks (common.join_spread).

Results at the edges: null or blank text has an empty set and is alone; fewer than five words
make one shingle; equal word sequences are one class under its smallest id; rows that repeat a
doc_id are placed each by its own text, two classes under one smallest id are one; a null doc_id
joins the class of its text, in a class without any id it is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import COLD_ROWS, HOT_PARTS, WordHashes, hot_keys, join_spread, materialize, mix64, read, windows

BANDS, ROWS = 32, 4
SHINGLE_WORDS = 5
THRESHOLD = (75, 100)
#: Cells of parities that all documents have, and of those that sets of more than WIDE_FROM shingles have besides.
CELLS, WIDE_CELLS, WIDE_FROM = 1024, 4096, 256
_CHUNK = 2048


def words_of(text: str | None) -> list[bytes]:
    """ASCII lower case, split at ASCII white space; bytes.split() knows no other."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _second(x: np.ndarray) -> np.ndarray:
    """A bijection of the 32-bit ring, in place."""
    t = np.empty_like(x)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(x, np.uint32(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=t)
    np.bitwise_xor(x, t, out=x)
    return x


def signature(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n circulant MinHash coordinates of a set of shingle hashes."""
    at = (mix64(shingles + np.uint64(0x51ED27)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(n, dtype=np.uint32)[:, None]
    for i in range(0, len(at), _CHUNK):
        np.minimum(out, _second(at[None, i : i + _CHUNK] + shifts).min(axis=1), out=out)
    return out


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, other bands' keys apart."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key + rows[:, j] + np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


def parities(shingles: np.ndarray, cells: int) -> np.ndarray:
    """A bit a cell, packed into longs: whether an odd number of the set's shingles fall there."""
    at = (mix64(shingles + np.uint64(0x2545F4)) % np.uint64(cells)).astype(np.int64)
    odd = (np.bincount(at, minlength=cells) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def maybe_similar(a: str, b: str) -> Column:
    """False only for pairs of structs (n, odd, wide) whose sets can't be linked."""
    least, most = THRESHOLD
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    room = (most - least) * (n_a + n_b)
    differing = lambda i: F.bit_count(F.get(F.col(f"{a}.odd"), F.lit(i)).bitwiseXOR(F.get(F.col(f"{b}.odd"), F.lit(i))))
    narrow = sum((differing(i) for i in range(1, CELLS // 64)), differing(0))
    wide = F.aggregate(F.zip_with(f"{a}.wide", f"{b}.wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = most * F.least(n_a, n_b) >= least * F.greatest(n_a, n_b)
    return sizes & ((most + least) * narrow <= room) & F.coalesce((most + least) * wide <= room, F.lit(True))


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        ids, n, cls, keys = batch.column("doc_id"), [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            if not words:
                n.append(0), cls.append(None), keys.append(None)
                continue
            found = np.unique(windows(memo.of(words), SHINGLE_WORDS))
            n.append(len(found)), keys.append(bands_of(signature(found)))
            cls.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=_SKETCH)


def sketch(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketch, "doc_id long, n_shingles long, cls binary, bands array<long>")


def _deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, longs = WordHashes(), pa.list_(pa.int64())
    for batch in batches:
        sets = [np.unique(windows(memo.of(words_of(x)), SHINGLE_WORDS)) for x in batch.column("text").to_pylist()]
        wide = [parities(x, WIDE_CELLS) if len(x) > WIDE_FROM else None for x in sets]
        columns = [pa.array(list(map(len, sets)), pa.int64()), pa.array([parities(x, CELLS) for x in sets], longs), pa.array(wide, longs)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["rep", "n", "odd", "wide"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    last, last_set = None, None
    for batch in batches:
        a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
        for i, x, y in zip(a, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if (i, x) != last:
                last, last_set = (i, x), np.unique(windows(memo.of(words_of(x)), SHINGLE_WORDS))
            other = np.unique(windows(memo.of(words_of(y)), SHINGLE_WORDS))
            both = len(np.intersect1d(last_set, other, assume_unique=True))
            keep.append(both > 0 and THRESHOLD[1] * both >= THRESHOLD[0] * (len(last_set) + len(other) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds linked to pairs (a, b): Jaccard similarity of the full sets against the threshold."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    # texts are wide and nothing is grouped behind these joins, so Spark itself splits a leader's pairs
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long, linked boolean")


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links to (node, component), the smallest node reachable; alternating stars, until nothing changes."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, seen = materialize(edges, "edges"), None
    n = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        hot = hot_keys(low, "u", 2 * n)
        low = low.select("u", F.least("u", "m").alias("m"))
        large = join_spread(both.where("v > u"), low, "u", hot, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_spread(large, low, "u", hot, "v")  # no node has more links here than before
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, n = now, now[0]
    every = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return every.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return verify(pairs, texts).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))


def _open_buckets(member: DataFrame, comp: DataFrame, hot: DataFrame) -> DataFrame:
    """(bucket, rep, comp, main) of buckets whose members lie in several components; main is the largest."""
    placed = member.select("bucket", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    sizes = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("bucket", "main")
    return join_spread(placed, main, "bucket", hot, "rep").select("bucket", "rep", "comp", "main")


def _apart(some: DataFrame, open_: DataFrame, bits: DataFrame, once: bool = False) -> DataFrame:
    """Pairs (a, b) of a row of some and a member of its bucket in another component that may be similar.

    With once, some are the rows outside main components, and a pair leaves the join in the first of its common buckets alone.
    The rows of a large bucket meet in a grid: each cell has a part of some and a part of the members.
    """
    sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("comp") != F.col("main")).alias("k"))
    limit = max(COLD_ROWS, -(-open_.count() // HOT_PARTS))
    columns = F.greatest(F.ceil(F.col("k") / limit).cast("int"), F.lit(1)) if once else F.lit(1)
    grid = F.broadcast(sizes.where(F.col("n") > limit).select("bucket", columns.alias("gx"), F.ceil(F.col("n") / limit).cast("int").alias("gy")))

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        parts, copies = (F.coalesce(f"g{c}", F.lit(1)) for c in (own, other))
        rows = rows.join(grid, "bucket", "left").withColumn(own + "_cell", F.pmod(F.xxhash64(by), parts).cast("int"))
        return rows.withColumn(other + "_cell", F.explode(F.sequence(F.lit(0), copies - 1))).drop("gx", "gy")

    x = some.join(bits, "rep").select("bucket", F.col("rep").alias("x"), F.col("comp").alias("xc"), F.col("parity").alias("xp"), F.col("bands").alias("xb"))
    wanted = (F.col("xc") != F.col("comp")) & maybe_similar("xp", "parity")
    if once:
        wanted &= F.array_min(F.array_intersect("xb", "bands")) == F.col("bucket")
    x, y = dealt(x, "x", "x", "y"), dealt(open_.join(bits, "rep"), "rep", "y", "x")
    return x.join(y, ["bucket", "x_cell", "y_cell"]).where(wanted).select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_shingles, component_id, kept), one row per row."""
    sketched = materialize(sketch(docs), "sketch")
    classes = sketched.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "classes")
    first = sketched.join(classes, (sketched["cls"] == classes["cls"]) & (sketched["doc_id"] == classes["rep"])).select("rep", "bands")
    banded = materialize(first.select("rep", F.explode("bands").alias("bucket")), "bands")

    # two leaders of each bucket by a hash of the member alone: the same ones in many buckets, so their pairs fall together
    banded = banded.withColumn("h", F.xxhash64("rep"))
    ends = banded.groupBy("bucket").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    ends = materialize(ends, "ends")
    hot = materialize(hot_keys(ends, "bucket"), "hot")
    member = materialize(join_spread(banded, ends.drop("n"), "bucket", hot, "rep").distinct(), "members")
    leader = member.where("h = lo or h = hi").select("bucket", F.col("rep").alias("lead"))
    stars = join_spread(member, leader, "bucket", hot, "rep").where("rep <> lead").select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    stars = materialize(stars, "pairs")
    ids = stars.select(F.col("a").alias("doc_id")).union(member.select("rep")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").join(ids, "doc_id", "left_semi")
    texts = materialize(texts, "texts")
    links = materialize(_links(stars, texts), "links")
    comp = materialize(components(links), "components")

    open_ = materialize(_open_buckets(member, comp, hot), "open")
    deep = texts.join(open_.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    bits = deep.mapInArrow(_deep, "rep long, n long, odd array<long>, wide array<long>").distinct()
    # an id with several texts has a row for each, so that none of them is overlooked
    bits = bits.select("rep", F.struct("n", "odd", "wide").alias("parity")).join(first.distinct(), "rep")
    bits = materialize(bits, "bits")
    # in open buckets two more leaders, other ones in each bucket; then what still lies apart with all members
    seconds = open_.withColumn("h", F.xxhash64("bucket", "rep"))
    ends = seconds.groupBy("bucket").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    seconds = join_spread(seconds, ends, "bucket", hot, "rep").where("h = lo or h = hi").select(open_.columns)
    near = materialize(_apart(seconds, open_, bits).join(stars, ["a", "b"], "left_anti"), "pairs")
    more = materialize(_links(near, texts), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        comp = materialize(components(links), "components")
        open_ = materialize(_open_buckets(open_, comp, hot), "open")
    rest = _apart(open_.where("comp <> main"), open_, bits, once=True)
    rest = materialize(rest.join(stars.unionByName(near), ["a", "b"], "left_anti"), "pairs")
    more = materialize(_links(rest, texts), "links")
    if not more.isEmpty():
        comp = materialize(components(links.unionByName(more)), "components")

    placed = classes.join(comp, F.col("rep") == F.col("node"), "left").select("cls", "rep", "component")
    named = join_spread(sketched.select("doc_id", "cls", "n_shingles"), placed, "cls", hot_keys(classes, "cls"), "doc_id", "left")
    own = F.coalesce("component", "rep", "doc_id")
    return named.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.col("rep").isNull()).alias("kept"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
