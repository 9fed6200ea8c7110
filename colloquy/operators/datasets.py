"""Standardization, splits, statistics, history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def yes_no_answer(raw: Column) -> Column:
    return F.when(F.lower(raw) == "true", "yes").otherwise("no")


def labels_for(n: Column) -> Column:
    """A, B, C ... for n choices; none for 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(i + 65))).otherwise(F.array().cast("array<string>"))


def choice_answer(index: Column, text: Column, n: Column) -> Column:
    """An index below n (4 if there are no choices) to its letter, else empty; a text to upper case without parentheses."""
    limit = F.when(n == 0, 4).otherwise(n)
    return F.when(index.isNotNull(), F.when(index < limit, F.char(index + 65)).otherwise("")).otherwise(F.btrim(F.upper(F.coalesce(text, F.lit(""))), F.lit("()")))


def stratified_split(rows: DataFrame, stratum: str, key: str, test: float = 0.25, validation: float = 0.10, seed: int = 42) -> DataFrame:
    """Adds split: per stratum, by a seeded hash order, floor(n * test) test rows, floor(n * validation) validation rows, the rest train.

    Counts by the hash's first three hex digits place all rows but those of the two digits where a split ends; these
    alone are ranked. So no task sorts a stratum, and sizes are exact.
    """
    hashed = rows.withColumn("_md5", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).withColumn("_digits", F.substring("_md5", 1, 3))
    counts = hashed.groupBy(F.col(stratum).alias("_stratum"), F.col("_digits").alias("_d")).agg(F.count(F.lit(1)).alias("_in"))
    own = Window.partitionBy("_stratum")
    counts = counts.withColumn("_n", F.sum("_in").over(own)).withColumn("_to", F.sum("_in").over(own.orderBy("_d")))
    counts = counts.withColumn("_first", F.floor(F.col("_n") * F.lit(float(test)))).withColumn("_second", F.col("_first") + F.floor(F.col("_n") * F.lit(float(validation))))
    side = lambda at: F.when(at <= F.col("_first"), "test").when(at <= F.col("_second"), "validation").otherwise("train")
    begin, end = side(F.col("_to") - F.col("_in") + 1), side(F.col("_to"))
    placed = counts.select("_stratum", "_d", F.when(begin == end, end).alias("split"), (F.col("_to") - F.col("_in")).alias("_before"), "_first", "_second")
    joined = hashed.join(placed, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_digits") == F.col("_d")))
    order = Window.partitionBy("_stratum", "_d").orderBy("_md5", key)
    ranked = joined.where("split is null").withColumn("split", side(F.col("_before") + F.row_number().over(order)))
    return joined.where("split is not null").unionByName(ranked).select(*rows.columns, "split")


def answer_distribution(rows: DataFrame, answer: str) -> DataFrame:
    """(answer, n, ratio) over non-empty answers."""
    counts = rows.where(F.col(answer) != "").groupBy(F.col(answer).alias("answer")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def dataset_statistics(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Per group (or of all rows): count, task_types, avg_question_length in words over non-empty questions, answers by count."""
    words = F.size(F.filter(F.split("question", r"(?U)\s+"), lambda x: x != ""))
    keys = [by] if by else []
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("task_type")).alias("task_types"), F.bround(F.coalesce(F.avg(F.when(F.col("question") != "", words)), F.lit(0.0)), 1).alias("avg_question_length"))
    counts = rows.where(F.col("answer") != "").groupBy(*keys, "answer").agg(F.count(F.lit(1)).alias("c"))
    total = F.aggregate("cs", F.lit(0).cast("long"), lambda a, x: a + x["c"])
    shares = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("answer", "c"))).alias("cs"))
    shares = shares.select(*keys, F.map_from_entries("cs").alias("answer_distribution"), F.map_from_entries(F.transform("cs", lambda x: F.struct(x["answer"], F.bround(x["c"] / total, 4)))).alias("answer_ratios"))
    if by:
        return whole.join(shares, by, "left")
    both = whole.unionByName(shares, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def isolate(rows: DataFrame, task: Callable[[dict], dict], schema: str) -> DataFrame:
    """Rows through a Python task, a batch at a time; a row whose task raises has its error and nulls, the rest go on."""
    kinds = T._parse_datatype_string(schema)
    names, arrow = [f.name for f in kinds.fields], to_arrow_schema(T.StructType([*kinds.fields, T.StructField("error", T.StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append({**task(row), "error": None})
                except Exception as e:  # the row is the unit that may fail
                    out.append({**{n: row.get(n) for n in names}, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, f"{schema}, error string")


def rounds_of(turns: DataFrame) -> DataFrame:
    """Conversations to rounds (conv_id, round, actor, critic): user and assistant turns in pairs."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    ranked = turns.where("role <> 'system'").withColumn("_rank", F.row_number().over(order) - 1)
    return ranked.groupBy("conv_id", F.floor(F.col("_rank") / 2).cast("int").alias("round")).agg(
        F.max(F.when(F.col("_rank") % 2 == 0, F.col("text"))).alias("actor"), F.max(F.when(F.col("_rank") % 2 == 1, F.col("text"))).alias("critic")
    )


def with_history(rounds: DataFrame) -> DataFrame:
    """Adds history, the interleaved turns of earlier rounds, and actor_history, the actor's alone."""
    before = Window.partitionBy("conv_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    pair = F.array(F.coalesce("actor", F.lit("")), F.coalesce("critic", F.lit("")))
    return rounds.withColumn("history", F.flatten(F.collect_list(pair).over(before))).withColumn("actor_history", F.collect_list("actor").over(before))


def responses_text(responses: Column) -> Column:
    return F.array_join(F.transform(responses, lambda x, i: F.concat(F.lit("\nPerson "), (i + 1).cast("string"), F.lit(" said: "), x)), "")


def named_responses_text(responses: Column) -> Column:
    """The same from a map of speaker to response, in the order of the speakers."""
    entries = F.array_sort(F.map_entries(responses))
    return F.array_join(F.transform(entries, lambda x: F.concat(F.lit("\nPerson "), x["key"].cast("string"), F.lit(" said: "), x["value"])), "")
