"""Chat formatting: prefix-target expansion. DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, its text alone under
the loss mask. Turns after the last assistant turn (or all turns, where there is none) form one
more example without loss, so no row of the input is lost.

Results at the edges: null text or role is empty; rows of null conv_id form one conversation
with null id; turns order by (turn, role, text), null turn first; repeated rows are turns of
their own; an empty table gives no example; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: The template's control strings. In texts and roles, an escape follows each first character of one.
BEGIN, ROLE, END_ROLE, END = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPED_CONTROL = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    r"""Doubles backslashes, then puts one after each < and [; so no control string is left."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def expand(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, example, formatted, loss_start, loss_length), offsets in code points."""
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    heads = F.transform("t", lambda x: F.concat(F.lit(BEGIN + ROLE), escape(x["role"]), F.lit(END_ROLE)))
    conv = conv.select("conv_id", "t", F.transform("t", lambda x: escape(x["text"])).alias("body"), heads.alias("head"))
    conv = conv.withColumn("turn_text", F.zip_with("head", "body", lambda h, b: F.concat(h, b, F.lit(END))))
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["role"] == "assistant")
    ends = F.when(F.element_at(F.col("t"), -1)["role"] == "assistant", ends).otherwise(F.concat(ends, F.array(F.size("t"))))
    each = conv.withColumn("ends", ends).select("*", F.posexplode("ends").alias("example", "i"))
    trained = F.element_at("t", F.col("i"))["role"] == "assistant"
    before = F.array_join(F.slice("turn_text", F.lit(1), F.col("i") - 1), "")
    each = each.withColumn("before", F.concat(before, F.element_at("head", F.col("i"))))
    return each.select(
        "conv_id",
        "example",
        F.concat("before", F.element_at("body", F.col("i")), F.lit(END)).alias("formatted"),
        F.when(trained, F.char_length("before")).otherwise(0).alias("loss_start"),
        F.when(trained, F.char_length(F.element_at("body", F.col("i")))).otherwise(0).alias("loss_length"),
        (F.col("example") == F.size("ends") - 1).alias("is_last"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>."""
    pieces = F.split(formatted, F.lit("</s>"))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    cut = len(BEGIN + ROLE) + 1

    def turn(p: Column) -> Column:
        at = F.locate(END_ROLE, p)
        return F.struct(unescape(F.substring(p, F.lit(cut), at - cut)).alias("role"), unescape(F.substring(p, at + len(END_ROLE), F.char_length(p))).alias("text"))

    return F.transform(pieces, turn)


def digest(examples: DataFrame) -> DataFrame:
    """One row per conversation, all of it read back from the examples' text and mask."""
    loss = F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length"))
    turns = F.when(F.col("is_last"), parse(F.col("formatted")))
    each = examples.select(
        "conv_id",
        F.struct("example", unescape(loss).alias("loss")).alias("part"),
        F.char_length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.size(turns).cast("long")).alias("n_turns"),
        F.when(F.col("is_last"), F.sha2(F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)).alias("turns_sha256"),
    )
    out = each.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("turns_sha256").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ESCAPED_CONTROL).alias("text"))
    return digest(expand(turns.unionByName(control)))
