"""A training corpus from documents, in five stages; each takes all that its predecessor kept.

Filters keep what they can't judge. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, langid, mixing, neardup, quality
from colloquy.llm.common import materialize, scratch_path, scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a text's n-grams that the predicted language must know.
LEAST_KNOWN = 0.25
#: Words of a dictionary in the last stage, whose workers share an executor with what earlier stages left.
BPE_WORDS = 1 << 17


def _keyed(docs: DataFrame) -> DataFrame:
    """COLUMNS and _key, a 64-bit hash of all that a verdict depends on: rows of one key are alike, an id alone may be null or repeated."""
    parts = ["doc_id", "text", "lang", "source"]
    return docs.select(*COLUMNS, F.xxhash64(*parts, *[F.col(c).isNull() for c in parts]).alias("_key"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers go."""
    keyed = _keyed(docs)
    kept = quality.judge(keyed.withColumn("doc_id", F.col("_key"))).where("kept").select(F.col("doc_id").alias("_key"))
    return keyed.join(kept, "_key", "left_semi").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the filter knows, go."""
    return langid.attach(docs.select(*COLUMNS)).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("known") >= LEAST_KNOWN)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; in a group without any id all stay."""
    keyed = _keyed(docs)
    found = neardup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    found = materialize(keyed.select("_key", "doc_id").join(found, "_key"), "groups")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first"))
    nameless = found.where("doc_id is null").join(first.where("first.none"), "component_id", "left_semi")
    kept = first.select("first._key").unionByName(nameless.select("_key"))
    # rows alike but for n_chars are one document if they have an id
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    return keyed.join(kept, "_key", "left_semi").withColumn("_apart", apart).dropDuplicates(["_key", "_apart"]).select(*COLUMNS)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repetitions are rows with the same doc_id."""
    return mixing.repeat_rows(mixing.mix(docs.select(*COLUMNS)))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their digest and that of the decoded bytes."""
    ranks, pattern = bpe._public("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, ranks, pattern, ["doc_id", "lang", "source"], memo_words=BPE_WORDS).select("row.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near-dedup", near_duplicates),
    ("mixing", mixing_to_weights),
    ("byte-level BPE", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        with scratch_scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
