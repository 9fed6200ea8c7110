"""Mixing sources to target weights by capped water-filling. DataFrame functions only.

Results at the edges: null text has size 0; a null source is a source of its own, last in
order; sources of size 0 get target 0; an empty table gives an empty result; repeated rows
each count and are taken alike; a null doc_id is a value like others; documents of one id and
different texts are chosen apart; equal ratios of cap to weight clamp in order of source; the
caller's columns come back in a struct of their own, so that no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, read

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_EPOCHS, SEED = 1.5, 2, 20_240_601
#: Parts of a source by hash, 4096 at most; a source's error is half of a part at most.
PARTS = 4096


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds target to rows (source, source_size, weight), one per source.

    Clamping at the cap and resharing the excess in proportion ends at min(cap, level * weight)
    with one level for all. In order of cap / weight, the clamped sources come first, so running
    sums give the level: the first at which no later source exceeds its cap.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy((cap / F.col("weight")), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rated = sources.withColumn("_level", level).withColumn("_cap", cap)
    rated = rated.withColumn("_found", F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level")))).over(every))
    target = F.when(F.col("_found").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_found")["_level"] * F.col("weight")))
    return rated.withColumn("target", target).drop("_level", "_cap", "_found")


def with_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds weight by the rank of source in code-point order, null last."""
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), rank.cast("int") + 1))


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Rows (source, source_size, target, _whole, _last) from rows (source, _size, _part): take each document _whole times, and once more if its part is at most _last."""
    by_part = sized.groupBy("source", "_part").agg(F.sum("_size").alias("part_size"))
    by_source = by_part.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    filled = water_fill(with_weights(by_source, weights), share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = filled.withColumn("_whole", F.least(F.floor(rate), F.lit(max_epochs))).withColumn("_goal", F.col("target") - F.col("_whole") * F.col("source_size"))
    so_far = F.sum("part_size").over(Window.partitionBy("source").orderBy("_part")) - F.col("part_size") / 2
    ranked = by_part.withColumn("_mid", so_far)
    goals = filled.select(F.col("source").alias("_s"), "source_size", "target", "_whole", "_goal")
    joined = ranked.join(goals, F.col("source").eqNullSafe(F.col("_s")))
    taken = F.max(F.when((F.col("_mid") <= F.col("_goal")) & (F.col("_whole") < max_epochs), F.col("_part")))
    return joined.groupBy("source", "source_size", "target", "_whole").agg(F.coalesce(taken, F.lit(-1)).alias("_last"))


def part_of(seed: int, parts: int) -> Column:
    """A part of 0 to parts - 1 (4096 at most) by the MD5 of seed, doc_id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text")))
    return F.conv(F.substring(digest, 1, 3), 16, 10).cast("int") % F.lit(parts)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, parts: int = PARTS) -> DataFrame:
    """(row, size, source_size, target, copies): row has all columns of docs, copies is 0 to max_epochs.

    A source's rate is target / size. Every document is taken floor(rate) times; of the seeded
    hash parts of the source, the first ones whose sizes sum to the rest are taken once more.
    The choice depends on doc_id, text and seed alone, so reruns agree.
    """
    part = part_of(seed, parts).alias("_part")
    plan = materialize(plan_mix(docs.select("source", text_size(F.col("text")).alias("_size"), part), weights, share, max_epochs), "mix")
    plan = plan.withColumnRenamed("source", "_src")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(whole, F.col("source").alias("_own"), text_size(F.col("text")).alias("size"), part)
    out = out.join(plan, F.col("_own").eqNullSafe(F.col("_src")), "left")
    return out.select("row", "size", "source_size", "target", (F.col("_whole") + (F.col("_part") <= F.col("_last")).cast("int")).cast("int").alias("copies"))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The caller's rows, each as often as the mix takes it."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
