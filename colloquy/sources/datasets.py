"""Named question sets: how their raw rows become samples, and their splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import datasets as D


@dataclass(frozen=True)
class DatasetSpec:
    task_type: str
    splits: tuple[str, ...] = ()
    stratum: str | None = None
    #: Where a set has its right answer and the wrong ones in columns of their own.
    correct: str | None = None
    distractors: tuple[str, ...] = ()


#: Splits that samples keep; raw splits of other names are dropped.
SPLITS = ("train", "validation", "test")
REGISTRY = {
    "boolq": DatasetSpec("yes_no", ("train", "validation")),
    "mmlu": DatasetSpec("multiple_choice", ("test", "validation", "dev")),
    "bbh": DatasetSpec("mixed", stratum="bbh_task"),
    "sciq": DatasetSpec("multiple_choice", ("train", "validation", "test"), correct="correct_answer", distractors=("distractor1", "distractor2", "distractor3")),
    "arc": DatasetSpec("multiple_choice", ("train", "validation", "test")),
}


def spec_of(name: str) -> DatasetSpec:
    if name not in REGISTRY:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def _text(raw: DataFrame, *names: str) -> Column:
    """The first of these columns that the table has, as text, empty where null."""
    found = next((n for n in names if n in raw.columns), None)
    return F.coalesce(F.col(found).cast("string"), F.lit("")) if found else F.lit("")


def _choices(raw: DataFrame) -> tuple[Column, Column]:
    none = F.array().cast("array<string>")
    if "choices" not in raw.columns:
        return none, none
    kind = raw.schema["choices"].dataType
    if isinstance(kind, T.StructType):
        texts, labels = F.coalesce(F.col("choices.text"), none), F.coalesce(F.col("choices.label"), none)
        return texts, F.when(F.size(labels) > 0, labels).otherwise(D.labels_for(F.size(texts)))
    texts = F.coalesce(F.col("choices"), none)
    return texts, D.labels_for(F.size(texts))


def standardize(raw: DataFrame, task_type: str, legacy: bool = True) -> DataFrame:
    """Adds question, passage, answer, choices, choice_labels and task_type to the key and split columns of raw.

    An answer is a letter's index in an integer column and text in any other. Mixed tasks have no rule of their own:
    legacy gives empty fields, else input and target are read.
    """
    kept = [c for c in ("sample_id", "split", "bbh_task") if c in raw.columns]
    none = F.array().cast("array<string>")
    if task_type == "yes_no":
        answer, choices, labels = D.yes_no_answer(_text(raw, "answer")), F.array(F.lit("Yes"), F.lit("No")), none
    elif task_type == "multiple_choice":
        choices, labels = _choices(raw)
        name = next((n for n in ("answer", "answerKey") if n in raw.columns), None)
        number = name is not None and isinstance(raw.schema[name].dataType, T.IntegralType)
        index = F.col(name).cast("int") if number else F.lit(None).cast("int")
        answer = D.choice_answer(index, F.lit(None).cast("string") if number else _text(raw, "answer", "answerKey"), F.size(choices))
    elif task_type == "mixed" and not legacy:
        return raw.select(*kept, _text(raw, "input", "question").alias("question"), F.lit("").alias("passage"), _text(raw, "target", "answer").alias("answer"), none.alias("choices"), none.alias("choice_labels"), F.lit(task_type).alias("task_type"))
    else:
        return raw.select(*[c for c in kept if c != "bbh_task"], F.lit("").alias("question"), F.lit("").alias("passage"), F.lit("").alias("answer"), none.alias("choices"), none.alias("choice_labels"), F.lit(task_type).alias("task_type"))
    return raw.select(*kept, _text(raw, "question").alias("question"), _text(raw, "passage").alias("passage"), answer.alias("answer"), choices.alias("choices"), labels.alias("choice_labels"), F.lit(task_type).alias("task_type"))


def choices_of_columns(raw: DataFrame, spec: DatasetSpec, seed: int = 42) -> DataFrame:
    """raw with choices and answer (a letter) from the columns of spec, in place of what it has under these names; support becomes the passage.

    Choices follow the MD5 of seed, sample_id and text, so that the right one stands anywhere and reruns agree. Null and empty
    distractors are no choices; without a right answer the letter is empty.
    """
    key = lambda c: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string"), c))
    columns = F.array(*[F.col(c).cast("string") for c in (spec.correct, *spec.distractors)])
    ordered = F.array_sort(F.transform(F.array_distinct(F.filter(columns, lambda c: c.isNotNull() & (c != ""))), lambda c: F.struct(key(c).alias("k"), c.alias("c"))))
    choices = F.transform(ordered, lambda x: x["c"])
    place = F.coalesce(F.array_position(choices, F.col(spec.correct).cast("string")), F.lit(0))
    passage = {"passage": F.col("support")} if "support" in raw.columns and "passage" not in raw.columns else {}
    return raw.withColumns({"choices": choices, "answer": F.when(place > 0, F.char(place + 64)).otherwise(""), **passage})


def load_dataset(spark: SparkSession, name: str, root: str, form: str = "parquet", seed: int = 42, legacy: bool = True) -> DataFrame:
    """Samples of a named set with their split; raw rows lie under root/name and carry sample_id.

    Sets with a stratum are split by it; the others carry a split column, of which SPLITS are kept. Answers in columns of their
    own are read without legacy only.
    """
    spec = spec_of(name)
    raw = text_rows(spark, f"{root}/{name}") if form == "text" else spark.read.format(form).load(f"{root}/{name}")
    if spec.stratum and "task" in raw.columns and spec.stratum not in raw.columns:
        # a folder for each task: task=name
        raw = raw.withColumnRenamed("task", spec.stratum)
    if spec.stratum:
        raw = raw.withColumn(spec.stratum, F.col(spec.stratum) if spec.stratum in raw.columns else F.lit("unknown"))
        raw = D.stratified_split(raw, spec.stratum, "sample_id", seed=seed)
    else:
        raw = raw.where(F.col("split").isin(*SPLITS))
    if not legacy and spec.correct in raw.columns:
        raw = choices_of_columns(raw, spec, seed)
    return standardize(raw, spec.task_type, legacy)


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows without fields: each line is the data of a sample, whose id is the hash of the line."""
    return spark.read.text(path).select(F.xxhash64("value").alias("sample_id"), F.col("value").alias("data"))


def evaluation_rows(samples: DataFrame) -> DataFrame:
    """The test rows, or those of validation where there is no test row."""
    tests = samples.where("split = 'test'")
    return samples.where("split = 'validation'") if tests.isEmpty() else tests


def first_samples(samples: DataFrame, n: int | None) -> DataFrame:
    """The first n by sample_id; all for 0 and None."""
    return samples.orderBy("sample_id").limit(n) if n else samples


def with_task(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Adds task_type and known by the registry, a table of a row a data set; rows of unknown sets stay, with the task type unknown."""
    known = rows.sparkSession.createDataFrame([(n, s.task_type) for n, s in REGISTRY.items()], f"`{dataset}` string, task_type string")
    out = rows.join(F.broadcast(known), dataset, "left")
    return out.withColumn("known", F.col("task_type").isNotNull()).withColumn("task_type", F.coalesce("task_type", F.lit("unknown")))
