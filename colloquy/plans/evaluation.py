"""A benchmark's results from deliberation rounds: per sample, per round and in one row."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import normalize_answer, strip
from .deliberation import wilson


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def same_normalized(predicted: Column, label: Column) -> Column:
    """Rule of accuracy and reward: equal first characters after normalization; empty equals empty."""
    return normalize_answer(predicted) == normalize_answer(label)


def same_stripped(predicted: Column, label: Column) -> Column:
    """Rule of sample details: equal in upper case, white space around the label ignored."""
    return F.upper(predicted) == strip(F.upper(label))


def same_upper(predicted: Column, label: Column) -> Column:
    """Rule of counts by round: equal in upper case."""
    return F.upper(predicted) == F.upper(label)


def sample_details(turns: DataFrame) -> DataFrame:
    """One row a sample: first and last answer against the label."""
    ends = turns.groupBy("sample_id").agg(F.min_by(_or_empty("actor_answer"), "round").alias("initial_answer"), F.max_by(_or_empty("actor_answer"), "round").alias("final_answer"), F.first("answer").alias("label"))
    first, last = (same_stripped(F.col(c), _or_empty("label")) for c in ("initial_answer", "final_answer"))
    return ends.select("*", first.alias("initial_correct"), last.alias("final_correct"), (~first & last).alias("flipped_to_correct"), (first & ~last).alias("flipped_to_wrong"))


def by_round(turns: DataFrame) -> DataFrame:
    """(round, n, accuracy, correct); accuracy and correct follow their own rules of equality."""
    label = _or_empty("answer")
    right = same_normalized(F.col("actor_answer"), label).cast("double")
    return turns.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy"), F.count_if(same_upper(_or_empty("actor_answer"), label)).alias("correct"))


def improvement_rate(final: Column, initial: Column) -> Column:
    return F.when(initial == 0, 0.0).otherwise((final - initial) / initial)


def evaluate(turns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row of all results; no row for no turns. Turns are read once: a row a sample, then a row a round.

    Samples with an error are counted as num_failed and enter nothing else. Times are those of the replies, where turns have seconds.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    label = _or_empty("answer")
    failed = F.max(F.col("error").isNotNull()) if "error" in turns.columns else F.lit(False)
    took = F.sum("seconds") if "seconds" in turns.columns else F.lit(None).cast("double")
    answer = F.struct("round", F.coalesce("actor_answer", F.lit("")).alias("answer"), same_normalized(F.col("actor_answer"), label).cast("double").alias("right"), same_upper(_or_empty("actor_answer"), label).alias("correct"))
    each = turns.groupBy("sample_id").agg(F.array_sort(F.collect_list(answer)).alias("t"), F.first("answer").alias("label"), (~failed).alias("ok"), took.alias("took"))
    first, last = (same_stripped(F.element_at("t", i)["answer"], _or_empty("label")) for i in (1, -1))
    each = each.select(F.posexplode("t").alias("at", "x"), first.alias("was"), last.alias("now"), "ok", "took").select("at", "x.*", "was", "now", "ok", "took")
    kinds = {"correct_to_correct": (True, True), "wrong_to_correct": (False, True), "correct_to_wrong": (True, False), "wrong_to_wrong": (False, False)}
    begins = F.col("ok") & (F.col("at") == 0)
    flips = [F.count_if(begins & (F.col("was") == a) & (F.col("now") == b)).alias(k) for k, (a, b) in kinds.items()]
    counts = [F.count_if((F.col("at") == 0) & ~F.col("ok")).alias("num_failed"), F.sum(F.when(begins, F.col("took"))).alias("total_seconds")]
    rounds = each.groupBy("round").agg(F.count_if("ok").alias("n"), F.avg(F.when(F.col("ok"), F.col("right"))).alias("accuracy"), F.count_if(F.col("ok") & F.col("correct")).alias("correct"), *flips, *counts)
    of_round = F.when(F.col("n") > 0, F.struct("round", "n", "accuracy", "correct"))
    row = rounds.agg(F.array_sort(F.collect_list(of_round)).alias("r"), *[F.sum(k).alias(k) for k in (*kinds, "num_failed", "total_seconds")]).where("size(r) > 0")
    row = row.withColumns({"initial_accuracy": F.get("r", F.lit(0))["accuracy"], "final_accuracy": F.element_at("r", -1)["accuracy"], "num_samples": F.element_at("r", -1)["n"]})
    margin, final, initial = wilson(F.col("final_accuracy"), F.col("num_samples"), z), F.col("final_accuracy"), F.col("initial_accuracy")
    accuracies = F.transform("r", lambda x: x["accuracy"])
    deltas = F.filter(F.transform(accuracies, lambda x, i: x - F.get(accuracies, i - 1)), lambda x: x.isNotNull())
    times = [F.round("total_seconds", 1).alias("total_seconds"), F.round(F.col("total_seconds") / F.greatest(F.col("num_samples"), F.lit(1)), 2).alias("average_seconds")]
    return row.select("num_samples", "num_failed", "initial_accuracy", "final_accuracy", margin.alias("margin"), F.greatest(F.lit(0.0), final - margin).alias("ci_low"), F.least(F.lit(1.0), final + margin).alias("ci_high"), improvement_rate(final, initial).alias("improvement_rate"), (final - initial).alias("absolute_gain"), accuracies.alias("per_round_accuracy"), deltas.alias("per_round_delta"), F.transform("r", lambda x: x["correct"]).alias("correct_at_each_round"), F.struct("correct_to_correct", "wrong_to_correct", "correct_to_wrong", "wrong_to_wrong").alias("flip_statistics"), *times)


def report(results: DataFrame) -> str:
    """The one row of results as text."""
    row = results.first()
    if row is None:
        return "No samples."
    flips = ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in row["flip_statistics"].asDict().items())
    rounds = "\n".join(f"Round {i}: {a:.3f}" for i, a in enumerate(row["per_round_accuracy"]))
    return f"Samples: {row['num_samples']}\n{rounds}\nFinal: {row['final_accuracy']:.3f} +- {row['margin']:.3f}\nGain: {row['absolute_gain']:+.3f}\nFlips: {flips}"
