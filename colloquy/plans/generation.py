"""Replies to prompts: what a reply is, responders over columns, and the runtime of Python models.

A reply is a struct (text, error, seconds). A prompt that is null is not asked: its reply has neither
text nor error. A prompt that was asked and has no text has an error, so that nothing downstream
takes it for an answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings

#: Adds a column of replies: rows, role, prompt, simulation number (0 outside simulations), name of the new column.
Responder = Callable[[DataFrame, str, Column, Column, str], DataFrame]

REPLY = "struct<text:string,error:string,seconds:double>"
NO_REPLY = "no reply"

CANNED = ("My answer is Yes.", "Final answer: No", "I believe No fits.", "Perhaps Yes at first; on balance No", "Clouds drift slowly.", "answer: yes", "")
CANNED_CHOICE = ("Final answer: (B)", "The answer is C.", "Option A looks right", "(D)", "None of them convinces me", "answer: a", "")


@dataclass(frozen=True)
class Sampling:
    """How a model draws its texts; n texts a prompt, each cut before the first of stop."""

    n: int = 1
    max_tokens: int = 256
    temperature: float = 0.7
    top_p: float = 0.9
    stop: tuple[str, ...] = ()
    seed: int = 42


def sampling_of(settings: Settings, **given) -> Sampling:
    """The sampling that settings name under generation, unless given otherwise."""
    known = {f.name for f in fields(Sampling)}
    named = {k: tuple(v) if k == "stop" else v for k, v in settings.section("generation").items() if k in known}
    return Sampling(**(named | given))


class Model(Protocol):
    def generate(self, prompts: list[str], sampling: Sampling) -> list[list[str]]:
        """sampling.n texts for each prompt."""

    def close(self) -> None: ...


def reply_of(text: Column, error: Column | None = None, seconds: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(text.alias("text"), (none if error is None else error).alias("error"), (F.lit(0.0) if seconds is None else seconds).alias("seconds"))


def canned_responder(replies: tuple[str, ...] = CANNED, seed: int = 42) -> Responder:
    """Replies chosen by the MD5 of role, seed, simulation and prompt; a column, without Python. It never fails, and says so, which spares plans its errors."""

    def respond(rows: DataFrame, role: str, prompt: Column, sim: Column, out: str) -> DataFrame:
        key = F.concat(F.lit(f"{role}|{seed}|"), sim.cast("string"), F.lit("|"), prompt)
        at = F.conv(F.substring(F.md5(key), 1, 6), 16, 10).cast("int") % len(replies)
        return rows.withColumn(out, reply_of(F.element_at(F.array(*map(F.lit, replies)), at + 1)))

    respond.never_fails = True
    return respond


def refusing_responder(respond: Responder, every: int, reason: str = "refused") -> Responder:
    """respond, but about one prompt in every is refused, by the prompt's MD5; stands for models that fail on some prompts."""

    def refuse(rows: DataFrame, role: str, prompt: Column, sim: Column, out: str) -> DataFrame:
        hit = F.conv(F.substring(F.md5(prompt), 7, 6), 16, 10).cast("int") % every == 0
        return respond(rows.withColumn("_hit", F.coalesce(hit, F.lit(False))), role, prompt, sim, out).withColumn(out, F.when(F.col("_hit"), reply_of(F.lit(None).cast("string"), F.lit(reason))).otherwise(F.col(out))).drop("_hit")

    return refuse


def calls(prompts: list[str], sampling: Sampling, budget: int, bytes_a_token: int = 4) -> Iterator[list[int]]:
    """Places of the prompts that go to the model at once: neighbours in length, at most budget tokens with all that is to be drawn.

    A model pads to the longest prompt, so a call costs its number of prompts times that; a prompt beyond the budget goes alone.
    """
    part: list[int] = []
    for i in sorted(range(len(prompts)), key=lambda i: len(prompts[i])):
        longest = len(prompts[i].encode()) // bytes_a_token + 1 + sampling.n * sampling.max_tokens
        if part and (len(part) + 1) * longest > budget:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def _answer(model: Model, asked: list[str], sampling: Sampling) -> list[tuple[list[str | None], str | None, float]]:
    """(texts, error, seconds) of each prompt; a call that fails is repeated prompt by prompt, since the prompt is the unit that may fail."""
    began = time.perf_counter()
    try:
        texts = model.generate(asked, sampling)
        if len(texts) != len(asked) or any(len(x) != sampling.n for x in texts):
            raise ValueError(f"{sampling.n} texts for each of {len(asked)} prompts were asked for")
    except Exception as e:
        if len(asked) == 1:
            return [([None] * sampling.n, f"{type(e).__name__}: {e}", time.perf_counter() - began)]
        return [x for one in asked for x in _answer(model, [one], sampling)]
    share = (time.perf_counter() - began) / len(asked)
    return [(list(x), None, share) for x in texts]


def _runner(load: Callable[[], Model], sampling: Sampling, budget: int, out: str) -> Callable:
    kind = pa.list_(pa.struct([("text", pa.string()), ("error", pa.string()), ("seconds", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        try:
            for batch in batches:
                asked = batch.column("_prompt").to_pylist()
                places = [i for i, x in enumerate(asked) if x is not None]
                if model is None and places:
                    model = load()
                none = {"text": None, "error": None, "seconds": 0.0}
                found = [[none] * sampling.n for _ in asked]
                for call in calls([asked[i] for i in places], sampling, budget):
                    of = [places[i] for i in call]
                    for i, (texts, error, seconds) in zip(of, _answer(model, [asked[i] for i in of], sampling), strict=True):
                        found[i] = [{"text": x, "error": error or (NO_REPLY if x is None else None), "seconds": seconds / sampling.n} for x in texts]
                kept = [c for c in batch.schema.names if c != "_prompt"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], names=[*kept, out])
        finally:
            if model is not None:
                model.close()

    return run


def cut_at(text: Column, stop: tuple[str, ...]) -> Column:
    """text before the first of the stop strings; the same whether the model stops there or goes on."""
    return reduce(lambda t, s: F.substring_index(t, s, 1), stop, text)


def generate(rows: DataFrame, prompt: Column, load: Callable[[], Model], sampling: Sampling | None = None, out: str = "replies", budget: int = 65_536, profile: ResourceProfile | None = None) -> DataFrame:
    """rows with out, an array of sampling.n replies to prompt.

    A task loads its model at its first prompt and closes it at its end. A prompt that fails has its error in each of its
    replies, the others go on. profile gives the stage executors of its own, with accelerators say.
    """
    sampling = sampling or Sampling()
    if sampling.n < 1:
        raise ValueError("n is 1 at least")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out}` array<{REPLY}>"])
    got = rows.withColumn("_prompt", prompt).mapInArrow(_runner(load, sampling, budget, out), fields, profile=profile)
    return got.withColumn(out, F.transform(out, lambda x: reply_of(cut_at(x["text"], sampling.stop), x["error"], x["seconds"]))) if sampling.stop else got


def samples_of(generated: DataFrame, replies: str = "replies") -> DataFrame:
    """One row a reply: the other columns, draw (from 0), text, error, seconds."""
    others = [c for c in generated.columns if c != replies]
    return generated.select(*others, F.posexplode(replies).alias("draw", "_reply")).select(*others, "draw", "_reply.*")


def generate_single(model: Model, prompt: str, sampling: Sampling | None = None) -> str:
    """The first text for one prompt on the driver, empty if there is none."""
    found = model.generate([prompt], sampling or Sampling())
    return (found[0][0] if found and found[0] else None) or ""


def model_responder(load: Callable[[str], Model], sampling: Sampling | None = None, budget: int = 65_536, profile: ResourceProfile | None = None) -> Responder:
    """Replies of a role's model, one a prompt, by the runtime; a simulation is a draw with a seed of its own at the same prompt."""

    def respond(rows: DataFrame, role: str, prompt: Column, sim: Column, out: str) -> DataFrame:
        return generate(rows, prompt, lambda: load(role), sampling, out, budget, profile).withColumn(out, F.get(out, F.lit(0)))

    return respond


class CannedModel:
    """A model for tests and examples: texts by the MD5 of role, seed, draw and prompt; always the first draw at temperature 0."""

    def __init__(self, role: str = "actor", replies: tuple[str, ...] = CANNED):
        self.role, self.replies = role, replies

    def generate(self, prompts: list[str], sampling: Sampling) -> list[list[str]]:
        from hashlib import md5

        def text(prompt: str, draw: int) -> str:
            key = f"{self.role}|{sampling.seed}|{draw if sampling.temperature > 0 else 0}|{prompt}"
            return self.replies[int(md5(key.encode()).hexdigest()[:6], 16) % len(self.replies)]

        return [[text(x, i) for i in range(sampling.n)] for x in prompts]

    def close(self) -> None:
        return None
