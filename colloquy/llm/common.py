"""What the corpus operators share: reading, the shared scratch folder, words and their hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that a worker remembers the hashes of before it starts anew.
MEMO_WORDS = 1_000_000
#: A key with over one in HOT_PARTS of all rows is dealt over several tasks; there are fewer such keys than that, so that a
#: list of them may be broadcast. A key of at most COLD_ROWS rows is not split.
HOT_PARTS, COLD_ROWS = 1024, 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_colloquy_scratch", None)
    if own is None:
        own = spark.sparkContext._colloquy_scratch = tempfile.mkdtemp(prefix="colloquy-")
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path that no other call gives, under the application's own folder in the shared one."""
    return f"{_scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    scopes = getattr(spark.sparkContext, "_colloquy_scopes", [])
    return "/".join([shared_dir(spark), "colloquy", spark.sparkContext.applicationId, *scopes])


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that were not stored can't be read any more."""
    _delete(spark, _scratch_root(spark))


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end."""
    scopes = spark.sparkContext._colloquy_scopes = [*getattr(spark.sparkContext, "_colloquy_scopes", []), uuid.uuid4().hex]
    try:
        yield
    finally:
        _delete(spark, _scratch_root(spark))
        spark.sparkContext._colloquy_scopes = scopes[:-1]


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Cut the lineage by a table in the shared folder, which outlives lost executors."""
    spark, path = df.sparkSession, path or scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, path: str, **options: str) -> DataFrame:
    """A table in as many buckets of key as a shuffle has partitions; joins on key with what is read here leave it in place.

    The catalog forgets the table at once: the frame keeps its files and its buckets.
    """
    spark, name = df.sparkSession, f"colloquy_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.options(**options).option("path", path).bucketBy(n, key).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def hot_keys(counts: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """counts (key, n) to (key, _parts) for hot keys alone: fewer than HOT_PARTS rows, whatever the size of counts."""
    total = total if total is not None else counts.agg(F.sum("n")).first()[0] or 0
    limit = max(COLD_ROWS, -(-total // HOT_PARTS))
    return counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_parts"))


def join_spread(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """left joined to right on key; left's rows of a hot key are dealt by a hash of column by over parts that each have right's rows.

    With how = "left", rows without a key are dealt over HOT_PARTS.
    """
    hot, parts = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    dealt = F.when(F.col(key).isNull(), HOT_PARTS).otherwise(parts)
    left = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), dealt).cast("int")).drop("_parts")
    right = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def merged_splits(df: DataFrame, wanted: int = 128 << 20) -> DataFrame:
    """Join neighbouring input splits up to the wanted size, but leave every core a task."""
    spark = df.sparkSession
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    factor = max(1, wanted // max(1, size))
    n = df.rdd.getNumPartitions()
    return df.coalesce(max(1, n // factor, min(n, spark.sparkContext.defaultParallelism)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers with full avalanche; xor-shifts and odd multipliers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words (bytes); forgets all when full, which changes no result."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def windows(h: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the n-word windows of a text, in order; one of the whole text if it has fewer words, none if it has none."""
    if not len(h):
        return h
    n_here = min(n, len(h))
    out = np.full(len(h) - n_here + 1, n_here, np.uint64)
    for j in range(n_here):
        out += mix64(h[j : len(h) - n_here + 1 + j] + _STEP[j % 5] * np.uint64(j // 5 + 1)) * _STEP[j % 5]
    return mix64(out)
