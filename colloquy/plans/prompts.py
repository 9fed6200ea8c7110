"""Prompt templates of each data set as columns; our own wording over fixed variables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.datasets import responses_text

TYPES = ("single_shot", "deliberation", "guided_single_shot", "guided_deliberation", "critic", "guided_critic")
_ASK = {"yes_no": "Question: {question}\nPassage: {passage}\n", "choice": "Question: {question}\nA: {choice_a}\nB: {choice_b}\nC: {choice_c}\nD: {choice_d}\n"}
_FORM = {"yes_no": "Reply yes or no.", "choice": "Reply with one letter."}
_REST = {
    "single_shot": "{form}",
    "deliberation": "Others:{responses_text}\n{form}",
    "guided_single_shot": "Argue for {target_answer}. {form}",
    "guided_deliberation": "Others:{responses_text}\nArgue for {target_answer}. {form}",
    "critic": "Reply under review: {actor_response}\nGive feedback.",
    "guided_critic": "Reply under review: {actor_response}\nSteer towards {target_answer}.",
}
_KIND = {"boolq": "yes_no", "mmlu": "choice", "bbh": "choice", "sciq": "choice", "arc": "choice"}
#: The order in which values are put in where some choices are missing.
ORDER = ("question", "passage", "choice_a", "choice_b", "choice_c", "choice_d", "target_answer", "responses_text", "actor_response")


_TASK = {"boolq": "yes_no", "bbh": "mixed"}


def task_type(dataset: str) -> str:
    """How answers are read from replies: yes_no, multiple_choice or mixed."""
    if dataset not in _KIND:
        raise ValueError(f"unknown data set {dataset!r}")
    return _TASK.get(dataset, "multiple_choice")


def datasets() -> list[str]:
    return sorted(_KIND)


def template(dataset: str, prompt_type: str) -> str:
    if dataset not in _KIND:
        raise ValueError(f"unknown data set {dataset!r}")
    if prompt_type not in TYPES:
        raise ValueError(f"unknown prompt type {prompt_type!r}")
    kind = _KIND[dataset]
    return _ASK[kind] + _REST[prompt_type].replace("{form}", _FORM[kind])


def render(dataset: str, prompt_type: str, question: Column, passage: Column | None = None, choices: Column | None = None, responses: Column | None = None, target_answer: Column | None = None, actor_response: Column | None = None) -> Column:
    """The template with its values as one concat; null values are empty.

    With one to three choices the names of missing ones stay in the text as they stand, and values go in one after
    another in ORDER, so a name inside an earlier value is replaced too. Without choices all four are empty.
    """
    text = template(dataset, prompt_type)
    empty = F.lit("")
    given = {"question": question, "passage": passage, "target_answer": target_answer, "actor_response": actor_response, "responses_text": responses_text(responses) if responses is not None else None}
    bound = {k: F.coalesce(v, empty) if v is not None else empty for k, v in given.items()}
    n = F.coalesce(F.size(choices), F.lit(0)) if choices is not None else F.lit(0)
    letters = {f"choice_{x}": F.coalesce(F.get(choices, F.lit(i)), empty) if choices is not None else empty for i, x in enumerate("abcd")}
    bound |= letters
    parts = [bound[x[1:-1]] if x[:1] == "{" else F.lit(x) for x in re.split(r"(\{\w+\})", text) if x]
    whole = F.concat(*parts)
    if choices is None or "{choice_a}" not in text:
        return whole

    def put(done: Column, name: str) -> Column:
        filled = F.replace(done, F.lit("{" + name + "}"), bound[name])
        return F.when(n > "abcd".index(name[-1]), filled).otherwise(done) if name in letters else filled

    return F.when((n > 0) & (n < 4), reduce(put, ORDER, F.lit(text))).otherwise(whole)


def template_table(spark: SparkSession) -> DataFrame:
    """(dataset, prompt_type, task_type, template, segments), a row for each data set and type; a segment is a text or a name."""
    rows = []
    for name in datasets():
        for t in TYPES:
            parts = [x for x in re.split(r"(\{\w+\})", template(name, t)) if x]
            rows.append((name, t, task_type(name), template(name, t), [(None, x[1:-1]) if x[:1] == "{" else (x, None) for x in parts]))
    return spark.createDataFrame(rows, "dataset string, prompt_type string, task_type string, template string, segments array<struct<text:string,name:string>>")


def values_of(question: Column, passage: Column | None = None, choices: Column | None = None, responses: Column | None = None, target_answer: Column | None = None, actor_response: Column | None = None) -> Column:
    """What a template's names stand for in a row, as a map; null is empty."""
    given = {"question": question, "passage": passage, "target_answer": target_answer, "actor_response": actor_response, "responses_text": responses_text(responses) if responses is not None else None}
    given |= {f"choice_{x}": F.get(choices, F.lit(i)) if choices is not None else None for i, x in enumerate("abcd")}
    return F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.coalesce(v, F.lit("")) if v is not None else F.lit(""))])


def render_rows(rows: DataFrame, values: Column, n_choices: Column, out: str = "prompt") -> DataFrame:
    """rows (dataset, prompt_type and others) with out, for rows of several data sets and types in one plan; as render has it.

    The templates are a table of a row for each data set and type, whatever the size of rows, so they are broadcast. A row whose
    data set or type has no template gets null.
    """
    table = F.broadcast(template_table(rows.sparkSession).select("dataset", "prompt_type", F.col("template").alias("_template"), F.col("segments").alias("_segments")))
    with_values = rows.withColumn("_values", values).withColumn("_n", F.coalesce(n_choices, F.lit(0))).join(table, ["dataset", "prompt_type"], "left")
    whole = F.array_join(F.transform("_segments", lambda s: F.coalesce(s["text"], F.element_at("_values", s["name"]))), "")

    def put(done: Column, name: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(f"choice_{x}") for x in "abcd"]), name)
        filled = F.replace(done, F.concat(F.lit("{"), name, F.lit("}")), F.element_at("_values", name))
        return F.when((at == 0) | (at <= F.col("_n")), filled).otherwise(done)

    one_by_one = F.aggregate(F.array(*map(F.lit, ORDER)), F.col("_template"), put)
    some = F.col("_template").contains("{choice_a}") & (F.col("_n") > 0) & (F.col("_n") < 4)
    return with_values.withColumn(out, F.when(some, one_by_one).otherwise(whole)).select(*rows.columns, out)
