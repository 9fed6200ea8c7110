"""A trainer behind training.Trainer: direct preference optimization with a likelihood term, for a log-linear policy over hashed words.

The policy draws words: the weight w of a word's bucket gives it probability exp(w) / sum(exp(w)), so the log-probability of a
text is a sum over its words, and a step's loss and gradient are sums over preference rows. Rows are packed once, a text's
buckets and counts in arrays; a step reads them, takes the weights as one literal of BUCKETS numbers, and sums the gradient by
bucket with map-side partial sums: a task sends BUCKETS rows at most, and so does the whole to the driver.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores

BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Objective:
    """beta scales the margin of preference, nll the mean log-loss of a word of the chosen text."""

    beta: float = 0.1
    nll: float = 1.0
    rate: float = 1.0
    steps: int = 20


@dataclass
class Step:
    loss: float
    dpo: float
    nll: float
    #: Share of rows whose chosen text gained on the rejected one.
    preferred: float
    gradient: list[float] = field(repr=False, default_factory=list)


def bucket_of(word: Column, buckets: int = BUCKETS) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def packed(preferences: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(prompt, chosen, rejected and others) to (chosen, rejected), sorted arrays of the texts' buckets; null texts are empty."""
    words = lambda c: F.array_sort(F.transform(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: bucket_of(w, buckets)))
    return preferences.select(words("chosen").alias("chosen"), words("rejected").alias("rejected"))


def _literal(weights: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(weights)), "array<double>")


def log_total(weights: list[float]) -> float:
    top = max(weights)
    return top + math.log(sum(math.exp(w - top) for w in weights))


def scored(rows: DataFrame, weights: list[float], reference: list[float], objective: Objective) -> DataFrame:
    """packed rows with margin, dpo and nll (losses of a row), and pull and push, the gradient's factors."""
    of = lambda c, w: F.aggregate(c, F.lit(0.0), lambda s, b: s + F.get(_literal(w), b))
    total, before = log_total(weights), log_total(reference)
    gained = [now - then for now, then in zip(weights, reference, strict=True)]
    n_chosen, n_rejected = F.size("chosen"), F.size("rejected")
    margin = of("chosen", gained) - of("rejected", gained) - (n_chosen - n_rejected) * F.lit(total - before)
    scaled = F.col("margin") * F.lit(objective.beta)
    # log(1 + exp(-x)) and its derivative without overflow
    dpo = F.greatest(-scaled, F.lit(0.0)) + F.log1p(F.exp(-F.abs(scaled)))
    nll = (n_chosen * F.lit(total) - of("chosen", weights)) / F.greatest(n_chosen, F.lit(1))
    pull = -F.lit(objective.beta) / (1 + F.exp(scaled))
    return rows.withColumn("margin", margin).select("chosen", "rejected", "margin", dpo.alias("dpo"), nll.alias("nll"), pull.alias("pull"), (F.lit(-objective.nll) / F.greatest(n_chosen, F.lit(1))).alias("push"))


def step(rows: DataFrame, weights: list[float], reference: list[float], objective: Objective) -> Step | None:
    """Loss and gradient over all packed rows; None without rows."""
    each = scored(rows, weights, reference, objective)
    parts = F.concat(
        F.transform("chosen", lambda b: F.struct(b.alias("bucket"), (F.col("pull") + F.col("push")).alias("g"))),
        F.transform("rejected", lambda b: F.struct(b.alias("bucket"), (-F.col("pull")).alias("g"))),
        F.array(F.struct(F.lit(-1).alias("bucket"), F.lit(0.0).alias("g"))),  # a row's losses, counted once
    )
    flat = each.select("dpo", "nll", "margin", F.explode(parts).alias("p")).select("p.*", "dpo", "nll", "margin")
    own = F.col("bucket") == -1
    sums = flat.groupBy("bucket").agg(F.sum("g").alias("g"), F.count_if(own).alias("n"), F.sum(F.when(own, F.col("dpo"))).alias("dpo"), F.sum(F.when(own, F.col("nll"))).alias("nll"), F.count_if(own & (F.col("margin") > 0)).alias("won")).collect()
    whole = next((r for r in sums if r["bucket"] == -1), None)
    if whole is None:
        return None
    n, drawn = whole["n"], [0.0] * len(weights)
    for r in sums:
        if r["bucket"] >= 0:
            drawn[r["bucket"]] = r["g"] / n
    # each word also takes its probability from all buckets
    total, all_drawn = log_total(weights), sum(drawn)
    gradient = [g - math.exp(w - total) * all_drawn for g, w in zip(drawn, weights, strict=True)]
    dpo, nll = whole["dpo"] / n, whole["nll"] / n
    return Step(dpo + objective.nll * nll, dpo, nll, whole["won"] / n, gradient)


def read_weights(spark: SparkSession, path: str, buckets: int = BUCKETS) -> list[float]:
    """A model's weights, 0 for buckets that it has none for; BUCKETS rows."""
    weights = [0.0] * buckets
    for r in spark.read.schema("bucket int, weight double").parquet(path).where(F.col("bucket") < buckets).collect():
        weights[r["bucket"]] = r["weight"]
    return weights


def write_weights(spark: SparkSession, weights: list[float], path: str) -> None:
    spark.createDataFrame(list(enumerate(weights)), "bucket int, weight double").coalesce(1).write.mode("overwrite").parquet(path)


class LogLinearTrainer:
    """training.Trainer: full gradient steps from the base model's weights, which are the reference policy too."""

    def __init__(self, spark: SparkSession, root: str, objective: Objective | None = None, buckets: int = BUCKETS):
        self.spark, self.root, self.objective, self.buckets = spark, root, objective or Objective(), buckets
        self.losses: list[float] = []

    def train(self, agent: str, preferences: str, base: str) -> str:
        """A base that is no stored model is one of equal weights. Losses of the steps are in losses."""
        reference = read_weights(self.spark, base, self.buckets) if stores.complete(self.spark, base) else [0.0] * self.buckets
        at = f"{self.root}/models/{agent}-{uuid.uuid4().hex}"
        packed(stores.read_preferences(self.spark, preferences, agent), self.buckets).write.parquet(f"{at}/rows")
        rows, weights, self.losses = self.spark.read.parquet(f"{at}/rows"), list(reference), []
        for _ in range(self.objective.steps):
            found = step(rows, weights, reference, self.objective)
            if found is None:
                raise ValueError(f"no preference rows for {agent}")
            self.losses.append(found.loss)
            weights = [w - self.objective.rate * g for w, g in zip(weights, found.gradient, strict=True)]
        write_weights(self.spark, weights, f"{at}/weights")
        return f"{at}/weights"
