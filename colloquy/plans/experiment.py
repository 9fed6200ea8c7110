"""An experiment from samples to results: alternating training on pairs of the training split, then evaluation of the models it ends with."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..sources import datasets, stores
from . import training
from .deliberation import deliberate
from .evaluation import evaluate, sample_details
from .generation import Responder


@dataclass
class Result:
    outcome: training.Outcome
    #: One row of evaluate, and a row a sample.
    results: DataFrame
    details: DataFrame


def run(spark: SparkSession, samples: DataFrame, root: str, settings: Settings, trainer: training.Trainer, responder_of: Callable[[dict[str, str]], Responder], dataset: str = "boolq", log: stores.MetricLog | None = None) -> Result:
    """samples carry sample_id, split and what deliberate asks for; models and numbers are those of settings.

    Every phase is on a ledger under root: a run that broke off goes on with the same call. Pairs lie under the models that made
    them. Training reads the training split, validation (with a patience) the validation split, evaluation the test split or, where
    that is empty, the validation split; evaluation.max_samples takes the first of these, all for 0.
    """
    rounds, simulations = settings.require("deliberation.rounds"), settings.require("deliberation.simulations")
    patience = settings.get("training.patience")
    train, validation = samples.where("split = 'train'"), samples.where("split = 'validation'")

    def under(name: str, models: dict[str, str]) -> str:
        return f"{root}/{name}/{hashlib.md5(json.dumps(models, sort_keys=True).encode()).hexdigest()}"

    def turns_of(rows: DataFrame, name: str, models: dict[str, str]) -> DataFrame:
        return stores.cached(spark, under(name, models), "actor", 0, lambda: deliberate(rows, rounds, responder_of(models), dataset))

    def pairs_of_models(models: dict[str, str]) -> DataFrame:
        pairs, failed = training.generate_resumably(spark, train, under("generated", models), "actor", 0, responder_of(models), settings.get("generation.batches", 64), dataset=dataset, rounds=rounds, simulations=simulations, threshold=settings.get("deliberation.threshold", 0.0))
        if log:
            log.metrics("generate", {"failed_samples": failed.count()})
        return pairs

    def validate(models: dict[str, str]) -> float:
        record = training.validation_record(turns_of(validation, "validation", models), 0)
        if log:
            log.metrics("validate", {k: v for k, v in record.items() if k != "iteration"})
        return record["val_accuracy"]

    models = {agent: settings.get(f"model.{agent}", agent) for agent in stores.AGENTS}
    outcome = training.alternate(spark, f"{root}/training", models, pairs_of_models, trainer, validate if patience is not None else None, settings.get("training.iterations", 1), patience, settings.get("training.min_improvement", 0.0), settings.get("preferences.min_delta", 0.0), reuse=True)
    chosen = datasets.first_samples(datasets.evaluation_rows(samples), settings.get("evaluation.max_samples"))
    turns = turns_of(chosen, "evaluation", outcome.models)
    results, details = evaluate(turns), sample_details(turns.where("error is null"))
    stores.write_results(results, f"{root}/results")
    details.write.mode("overwrite").json(f"{root}/results/details")
    if log and (row := results.first()) is not None:
        log.metrics("evaluate", {k: row[k] for k in ("final_accuracy", "margin", "improvement_rate", "num_samples")})
    return Result(outcome, results, details)
