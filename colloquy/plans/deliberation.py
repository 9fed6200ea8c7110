"""Rounds of two agents, simulated rewards and preference pairs, over a responder that answers prompts.

A failed reply is nobody's answer: its error goes with the sample, whose later prompts are not asked, and a sample with an error
at any stage gives no pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import extract_answer, normalize_answer, wrong_answer
from . import prompts
from .generation import NO_REPLY, Responder, canned_responder


def _prompt(rows: DataFrame, dataset: str, kind: str, **bound: Column) -> Column:
    """A data set's prompt from a sample's columns; passage and choices where rows have them."""
    given = {c: F.col(c) for c in ("passage", "choices") if c in rows.columns}
    return prompts.render(dataset, kind, F.col("question"), **given, **bound)


def predicted(dataset: str, reply: Column) -> Column:
    return extract_answer(reply, F.lit(prompts.task_type(dataset)))


def _ask(rows: DataFrame, respond: Responder, role: str, prompt: Column, sim: Column, out: str, stage: Column, only: Column | None = None) -> DataFrame:
    """rows with out, the reply, and with error (a column of rows), now the first error of all so far, named by its stage.

    Rows with an error, and those outside only, are not asked.
    """
    wanted = F.col("error").isNull() if only is None else F.col("error").isNull() & only
    rows = respond(rows.withColumn("_asked", F.when(wanted, prompt)), role, F.col("_asked"), sim, out)
    if getattr(respond, "never_fails", False):
        return rows.drop("_asked")
    failed = F.when(F.col("_asked").isNotNull() & (F.col(out)["text"].isNull() | F.col(out)["error"].isNotNull()), F.concat(stage, F.lit(f" {role}: "), F.coalesce(F.col(out)["error"], F.lit(NO_REPLY))))
    return rows.withColumn("error", F.coalesce("error", failed)).drop("_asked")


def with_error(rows: DataFrame) -> DataFrame:
    return rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))


def deliberate(samples: DataFrame, rounds: int, respond: Responder | None = None, dataset: str = "boolq") -> DataFrame:
    """samples (sample_id, question, answer, and passage or choices) with one row a round: prompts, responses and the actor's answer.

    history is what the actor said in earlier rounds, error the sample's first error in any round, seconds what its replies of
    this round took. Rounds follow one another in one plan, in which every prompt is rendered and answered once.
    """
    respond = respond or canned_responder()
    out = with_error(samples).withColumn("_said", F.array().cast("array<string>")).withColumn("_h0", F.array().cast("array<string>"))
    turns = []
    for t in range(rounds):
        prompt = _prompt(out, dataset, "single_shot") if t == 0 else _prompt(out, dataset, "deliberation", responses=F.col("_said"))
        out = _ask(out.withColumn(f"_p{t}", prompt), respond, "actor", F.col(f"_p{t}"), F.lit(0), f"_a{t}", F.lit(f"round {t}"))
        out = out.withColumn(f"_q{t}", _prompt(out, dataset, "critic", actor_response=F.col(f"_a{t}.text")))
        out = _ask(out, respond, "critic", F.col(f"_q{t}"), F.lit(0), f"_c{t}", F.lit(f"round {t}"))
        out = out.withColumn("_said", F.concat("_said", F.array(f"_a{t}.text", f"_c{t}.text")))
        out = out.withColumn(f"_h{t + 1}", F.concat(f"_h{t}", F.array(f"_a{t}.text")))
        turns.append(F.struct(F.lit(t).alias("round"), F.col(f"_p{t}").alias("actor_prompt"), F.col(f"_a{t}.text").alias("actor_response"), F.col(f"_q{t}").alias("critic_prompt"), F.col(f"_c{t}.text").alias("critic_response"), predicted(dataset, F.col(f"_a{t}.text")).alias("actor_answer"), F.col(f"_h{t}").alias("history"), (F.col(f"_a{t}.seconds") + F.col(f"_c{t}.seconds")).alias("seconds")))
    kept = [c for c in samples.columns if c != "error"]
    return out.select(*kept, "error", F.explode(F.array(*turns)).alias("turn")).select(*kept, "turn.*", "error")


def with_earlier(turns: DataFrame) -> DataFrame:
    """Adds history, the actor's responses of the sample's earlier rounds, to turns that don't carry it."""
    if "history" in turns.columns:
        return turns
    before = Window.partitionBy("sample_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("history", F.collect_list(F.coalesce("actor_response", F.lit(""))).over(before))


def simulate(states: DataFrame, simulations: int, respond: Responder | None = None, dataset: str = "boolq", critic: bool = False) -> DataFrame:
    """Adds right (0 or 1) of each simulated next reply, one row a simulation; 0 without label or simulations, null without reply.

    The reply sees history (earlier responses, an array that states must have), then the actor's and the critic's response.
    error is that of the state or else of the simulated reply. With critic, the critic is asked about each simulated reply as
    well; what it says changes nothing, but its failure is the state's.
    """
    if "history" not in states.columns:
        raise ValueError("states need their history; see with_earlier")
    respond = respond or canned_responder()
    sims = with_error(states).withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(max(simulations, 1)))))
    prompt = _prompt(sims, dataset, "deliberation", responses=F.concat("history", F.array("actor_response", "critic_response")))
    label = normalize_answer(F.col("answer"))
    unscored = (label == "") | F.lit(simulations <= 0)
    sims = _ask(sims, respond, "actor", prompt, F.col("sim"), "_reply", F.concat(F.lit("round "), F.col("round").cast("string") if "round" in states.columns else F.lit("?"), F.lit(" simulated")), ~unscored)
    if critic:
        sims = _ask(sims, respond, "critic", _prompt(sims, dataset, "critic", actor_response=F.col("_reply.text")), F.col("sim"), "_feedback", F.concat(F.lit("round "), F.col("round").cast("string") if "round" in states.columns else F.lit("?"), F.lit(" simulated")), ~unscored).drop("_feedback")
    right = F.when(F.col("error").isNull(), F.when(unscored, 0.0).otherwise((normalize_answer(predicted(dataset, F.col("_reply.text"))) == label).cast("double")))
    return sims.withColumn("right", right).drop("_reply")


def rewards(states: DataFrame, keys: list[str], simulations: int, respond: Responder | None = None, dataset: str = "boolq", critic: bool = False) -> DataFrame:
    """(keys, reward, error): the share of simulated next replies that give the label; no reward where one of them failed."""
    found = simulate(states, simulations, respond, dataset, critic).groupBy(*keys).agg(F.avg("right").alias("reward"), F.min("error").alias("error"))
    return found.withColumn("reward", F.when(F.col("error").isNull(), F.col("reward")))


def guided_round(states: DataFrame, respond: Responder | None = None, dataset: str = "boolq", only: Column | None = None) -> DataFrame:
    """states (a sample's columns, round, history, target) with actor_response and critic_response argued towards target, and error.

    The actor of round 0 has seen nobody; later ones see history. The critic sees the guided reply. Rows outside only are not
    asked; they have no responses.
    """
    respond = respond or canned_responder()
    stage = F.concat(F.lit("round "), F.col("round").cast("string"), F.lit(" guided"))
    states = with_error(states)
    first, later = (_prompt(states, dataset, kind, target_answer=F.col("target"), **seen) for kind, seen in (("guided_single_shot", {}), ("guided_deliberation", {"responses": F.col("history")})))
    out = _ask(states, respond, "actor", F.when(F.size("history") == 0, first).otherwise(later), F.lit(0), "_guided", stage, only).withColumn("actor_response", F.col("_guided.text"))
    out = _ask(out, respond, "critic", _prompt(out, dataset, "guided_critic", actor_response=F.col("actor_response"), target_answer=F.col("target")), F.lit(0), "_steered", stage, only)
    return out.withColumn("critic_response", F.col("_steered.text")).drop("_guided", "_steered")


def select_pair(natural: Column, right: Column, wrong: Column, threshold: float = 0.0) -> Column:
    """(direction, delta): towards if guidance to the label gains threshold, else away if guidance from it loses that, else null."""
    gain, loss = right - natural, natural - wrong
    pair = lambda name, delta: F.struct(F.lit(name).alias("direction"), delta.alias("delta"))
    return F.when(gain >= threshold, pair("towards", gain)).when(loss >= threshold, pair("away", loss))


NAMES = ("natural", "right", "wrong")


def scored_variants(turns: DataFrame, simulations: int, respond: Responder | None = None, dataset: str = "boolq") -> DataFrame:
    """From round 1 on, a row a round: its prompts, the natural replies and those guided to the label and from it, their rewards, and error.

    Guidance sees the actor's earlier responses. A turn is read once: its three variants are rows of one frame, and only guided
    ones are asked anew.
    """
    late = with_error(with_earlier(turns)).where("round >= 1")
    away = wrong_answer(F.col("answer"), F.col("choices") if "choices" in turns.columns else F.array().cast("array<string>"))
    targets = F.array(*[F.struct(F.lit(v).alias("variant"), c.alias("target")) for v, c in zip(NAMES, (F.lit(""), F.col("answer"), away), strict=True)])
    each = late.withColumn("g", F.explode(targets)).select("*", "g.*").drop("g")
    each = each.withColumnsRenamed({"actor_response": "_actor", "critic_response": "_critic"})
    natural = F.col("variant") == "natural"
    each = guided_round(each, respond, dataset, ~natural)
    each = each.withColumns({f"{x}_response": F.when(natural, F.col(f"_{x}")).otherwise(F.col(f"{x}_response")) for x in ("actor", "critic")})
    # a turn has three rows for each simulation: its prompts are on one of them alone and its replies on three, lest sorts and shuffles carry each copy
    once = F.col("sim") == 1
    of = lambda v, c: F.when(F.col("variant") == v, F.col(c))
    narrow = simulate(each, simulations, respond, dataset).select(
        "sample_id", "round",
        *[F.when(once & natural, F.col(c)).alias(c) for c in ("actor_prompt", "critic_prompt")],
        "variant", "right", *[F.when(once, F.col(f"{agent}_response")).alias(agent) for agent in ("actor", "critic")], "error",
    )
    return narrow.groupBy("sample_id", "round").agg(
        *[F.max(c).alias(c) for c in ("actor_prompt", "critic_prompt")],
        *[F.avg(of(v, "right")).alias(f"{v}_reward") for v in NAMES],
        *[F.max(of(v, agent)).alias(f"{v}_{agent}") for v in NAMES for agent in ("actor", "critic")],
        F.min("error").alias("error"),
    )


def pairs_of(variants: DataFrame, threshold: float = 0.0) -> DataFrame:
    """At most one pair a row of scored_variants, as read_pairs has them; rows with an error give none."""
    wide = variants.where("error is null").withColumn("pair", select_pair(*[F.col(f"{v}_reward") for v in NAMES], threshold)).where("pair IS NOT NULL").select("*", "pair.*")
    better = lambda agent, good: F.when(F.col("direction") == "towards", F.col(f"{'right' if good else 'natural'}_{agent}")).otherwise(F.col(f"{'natural' if good else 'wrong'}_{agent}"))
    return wide.select("sample_id", "actor_prompt", "critic_prompt", better("actor", True).alias("positive"), better("actor", False).alias("negative"), better("critic", True).alias("positive_critic"), better("critic", False).alias("negative_critic"), "round", "delta", "direction")


def failures(rows: DataFrame) -> DataFrame:
    """(sample_id, error) of the samples that failed in some row."""
    return rows.where("error is not null").groupBy("sample_id").agg(F.min("error").alias("error"))


def quarantined(variants: DataFrame) -> DataFrame:
    """The rows with error that of the sample: one failed reply at any stage takes the sample out."""
    return variants.withColumn("error", F.min("error").over(Window.partitionBy("sample_id")))


def preference_pairs(turns: DataFrame, simulations: int, threshold: float = 0.0, respond: Responder | None = None, dataset: str = "boolq") -> DataFrame:
    """Pairs of all samples without an error at any stage, in one plan; training.generate_pairs stores each stage and lists the others.

    error of turns is that of the sample, as deliberate has it.
    """
    respond = respond or canned_responder()
    variants = scored_variants(turns, simulations, respond, dataset)
    return pairs_of(variants if getattr(respond, "never_fails", False) else quarantined(variants), threshold)


def wilson(accuracy: Column, n: Column, z: float = 1.959963984540054) -> Column:
    half = z * F.sqrt(accuracy * (1 - accuracy) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, half).otherwise(0.0)


def early_stop(accuracies: list[float], patience: int, least: float = 0.0) -> int:
    """Rounds run before patience rounds without improvement over the best by more than least."""

    def step(state: tuple[float, int, int], a: float) -> tuple[float, int, int]:
        best, waited, ran = state
        if waited >= patience:
            return state
        return (a, 0, ran + 1) if a > best + least else (best, waited + 1, ran + 1)

    return reduce(step, accuracies, (float("-inf"), 0, 0))[2]


def early_stop_column(accuracies: Column, patience: int, least: float = 0.0) -> Column:
    """The same fold over an array."""
    state = lambda best, waited, ran: F.struct(best.alias("best"), waited.alias("waited"), ran.alias("ran"))

    def step(s: Column, a: Column) -> Column:
        better = a > s["best"] + F.lit(least)
        on = state(F.when(better, a).otherwise(s["best"]), F.when(better, F.lit(0)).otherwise(s["waited"] + 1), s["ran"] + 1)
        return F.when(s["waited"] >= patience, s).otherwise(on)

    return F.aggregate(accuracies, state(F.lit(float("-inf")), F.lit(0), F.lit(0)), step, lambda s: s["ran"])
