"""Alternating training on the driver: preferences are tables, training is behind a protocol."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import stores
from .deliberation import deliberate, failures, pairs_of, scored_variants
from .evaluation import evaluate
from .generation import Responder


class Trainer(Protocol):
    def train(self, agent: str, preferences: str, base: str) -> str:
        """Trains from the model at base on the table of preferences; returns the new model's path."""


@dataclass
class Outcome:
    models: dict[str, str]
    history: list[dict] = field(default_factory=list)
    #: Stays 0 without patience.
    best: float = 0.0
    stopped: bool = False


def preference_rows(pairs: DataFrame, min_delta: float = 0.0) -> DataFrame:
    """(agent, sample_id, prompt, chosen, rejected, round, delta, direction) of both agents; pairs below min_delta go (no delta: 0)."""
    kept = pairs.where(F.coalesce("delta", F.lit(0.0)) >= min_delta)
    sides = F.array(
        F.struct(F.lit("actor").alias("agent"), F.col("actor_prompt").alias("prompt"), F.col("positive").alias("chosen"), F.col("negative").alias("rejected")),
        F.struct(F.lit("critic").alias("agent"), F.col("critic_prompt").alias("prompt"), F.col("positive_critic").alias("chosen"), F.col("negative_critic").alias("rejected")),
    )
    return kept.select("sample_id", "round", "delta", "direction", F.explode(sides).alias("s")).select("s.*", "sample_id", "round", "delta", "direction")


def generate_pairs(spark: SparkSession, samples: DataFrame, root: str, agent: str, iteration: int, respond: Responder | None = None, dataset: str = "boolq", rounds: int = 5, simulations: int = 5, threshold: float = 0.0, reuse: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pairs, failed): preference pairs of all samples, stored by agent and iteration, and (sample_id, error) of samples that failed.

    Turns and then scored variants are stored before pairs are made from them, so every prompt is answered once. A sample of
    which some reply failed at any stage gives no pair; the others go on.
    """
    store = lambda name, make: stores.cached(spark, f"{root}/{name}", agent, iteration, make, reuse)
    turns = store("turns", lambda: deliberate(samples, rounds, respond, dataset))
    variants = store("variants", lambda: scored_variants(turns.where("error is null"), simulations, respond, dataset))
    failed = failures(turns.select("sample_id", "error").unionByName(variants.select("sample_id", "error")))
    pairs = store("pairs", lambda: pairs_of(variants.join(failed.select("sample_id"), "sample_id", "left_anti"), threshold))
    return pairs, failed


def generate_resumably(spark: SparkSession, samples: DataFrame, root: str, agent: str, iteration: int, respond: Responder | None = None, batches: int = 64, **how) -> tuple[DataFrame, DataFrame]:
    """As generate_pairs, in batches of samples that are committed one after another; a call on the same root goes on where one broke off.

    A ledger under root names the committed batches. Samples of those are left out by an anti join, so new samples may come
    later; the rest falls into parts by a hash of sample_id, and a part's next batch has a name that a broken run had as well,
    so what that left behind is reused where its stage was committed and overwritten where not. No prompt of a committed stage is
    answered twice.
    """
    base = f"{root}/agent={agent}/iteration={iteration}"
    ledger = stores.Ledger(spark, f"{base}/_ledger")
    part = F.pmod(F.xxhash64("sample_id"), F.lit(batches)).cast("int")
    for _ in range(2):  # once more for samples that came after a broken run whose batch was reused
        committed = ledger.names()
        rest = samples
        if committed:
            done = spark.read.schema("sample_id long").parquet(*[f"{base}/{name}/samples" for name in committed])
            rest = samples.join(done, "sample_id", "left_anti")
        parts = sorted(r[0] for r in rest.select(part.alias("part")).distinct().collect())  # batches rows at most
        if len(parts) > 1:
            # dealt out once, so that a batch reads its own samples alone
            dealt = f"{base}/_dealt-{uuid.uuid4().hex}"
            rest.withColumn("_part", part).write.partitionBy("_part").parquet(dealt)
        for p in parts:
            name = f"part={p:05d}-{sum(x.startswith(f'part={p:05d}-') for x in committed):05d}"
            chosen = spark.read.schema(samples.schema).parquet(f"{dealt}/_part={p}") if len(parts) > 1 else rest
            pairs, failed = generate_pairs(spark, chosen, f"{base}/{name}", agent, iteration, respond, **how)
            failed.write.mode("overwrite").parquet(f"{base}/{name}/failed")
            turns = spark.read.parquet(f"{base}/{name}/turns/agent={agent}/iteration={iteration}")
            turns.select("sample_id").distinct().write.mode("overwrite").parquet(f"{base}/{name}/samples")
            ledger.commit(name, {"agent": agent, "iteration": iteration})
        if len(parts) > 1:
            stores.delete(spark, dealt)
        if not parts:
            break
    names = ledger.names()
    if not names:
        return spark.createDataFrame([], stores.PAIRS), spark.createDataFrame([], "sample_id long, error string")
    return spark.read.schema(stores.PAIRS).parquet(*[f"{base}/{n}/pairs/agent={agent}/iteration={iteration}" for n in names]), spark.read.schema("sample_id long, error string").parquet(*[f"{base}/{n}/failed" for n in names])


def validation_record(turns: DataFrame, iteration: int) -> dict[str, float]:
    """The four fields that alternation keeps of a validation; zeros for no turns."""
    row = evaluate(turns).first()
    found = (row["final_accuracy"], row["margin"], row["improvement_rate"]) if row else (0.0, 0.0, 0.0)
    return {"iteration": iteration} | dict(zip(("val_accuracy", "val_ci_margin", "improvement_rate"), found, strict=True))


@dataclass(frozen=True)
class Adapter:
    """Low-rank adapter settings that a trainer is given."""

    rank: int
    alpha: int
    targets: tuple[str, ...]
    dropout: float = 0.0


def train_on_pairs(trainer: Trainer, pairs: DataFrame, path: str, agent: str, base: str, min_delta: float = 0.0) -> str:
    """Store an agent's preference rows, in place of all that it had there, and train on them; no rows raise."""
    if agent not in stores.AGENTS:
        raise ValueError(f"unknown agent {agent!r}")
    stores.write_preferences(preference_rows(pairs, min_delta).where(F.col("agent") == agent), path, (agent,))
    if stores.read_preferences(pairs.sparkSession, path, agent).isEmpty():
        raise ValueError(f"no preference rows for {agent}")
    return trainer.train(agent, path, base)


def train_agent(spark: SparkSession, samples: DataFrame, root: str, agent: str, iteration: int, trainer: Trainer, base: str, respond: Responder | None = None, min_delta: float = 0.0, **how) -> tuple[str, DataFrame]:
    """(new model, failed samples): one agent's phase as a whole, from samples over pairs and preference rows to training."""
    pairs, failed = generate_resumably(spark, samples, f"{root}/generated", agent, iteration, respond, **how)
    if pairs.isEmpty():
        raise ValueError(f"no preference pairs for {agent} in iteration {iteration}")
    return train_on_pairs(trainer, pairs, f"{root}/preferences/iteration={iteration}", agent, base, min_delta), failed


def alternate(spark: SparkSession, root: str, models: dict[str, str], pairs_of_models: Callable[[dict[str, str]], DataFrame], trainer: Trainer, validate: Callable[[dict[str, str]], float] | None = None, iterations: int = 1, patience: int | None = None, least: float = 0.0, min_delta: float = 0.0, reuse: bool = False) -> Outcome:
    """Critic, then actor, each trained on pairs of the models of that moment; stops after patience validations without gain.

    With reuse, pairs and phases of an earlier run on root are taken over: a ledger has the model path of each finished phase and
    the accuracy of each validation, so that a run that was broken off goes on and ends as an unbroken one does.
    """
    out, waited, best = Outcome(dict(models)), 0, float("-inf")
    run = "ledger" if reuse else f"ledger-{uuid.uuid4().hex}"
    ledger = stores.Ledger(spark, f"{root}/_{run}")

    def phase(name: str, make: Callable[[], dict]) -> dict:
        found = ledger.get(name)
        if found is None:
            ledger.commit(name, make())
            found = ledger.get(name)  # what another run committed first, if there was one
        return found

    def trained(i: int, agent: str) -> dict:
        now = dict(out.models)
        pairs = stores.cached(spark, f"{root}/pairs", agent, i, lambda: pairs_of_models(now), reuse)
        if pairs.isEmpty():
            raise ValueError(f"no preference pairs for {agent} in iteration {i}")
        return {"model": train_on_pairs(trainer, pairs, f"{root}/preferences/iteration={i}", agent, now[agent], min_delta), "base": now}

    for i in range(iterations):
        for agent in ("critic", "actor"):
            done = phase(f"{i:05d}-{agent}", lambda i=i, agent=agent: trained(i, agent))
            if done["base"] != out.models:
                raise ValueError(f"the ledger's phase {i} of {agent} began from other models")
            out.models[agent] = done["model"]
        if validate is None:
            continue
        accuracy = phase(f"{i:05d}-validation", lambda: {"accuracy": validate(dict(out.models))})["accuracy"]
        out.history.append({"iteration": i, "val_accuracy": accuracy})
        if patience is not None:
            better = accuracy > best + least
            best, waited = (accuracy, 0) if better else (best, waited + 1)
            out.best = best
            if waited >= patience:
                out.stopped = True
                break
    return out
