"""Conversation structure repair: the cheapest edits that make the roles of turns legal, by a Spark SQL fold.

Windows find each turn's first fault. A conversation's turns are then one sorted array, over which
aggregate() carries four structs, one for each state of the pattern (s?(ua)+)?: nothing yet, after
s, after u, after a. A struct is (cost, audit, script); least() of structs takes the lower cost,
then the ASCII-least audit. At one turn no audit of equal cost is a prefix of another (they have a
letter for each turn, and each insertion costs), so that the least so far stays the least. The
script has the audit's edits with the roles that they give: u or a inserted, 1 or 2 for a turn that
becomes user or assistant, K, D.

Results at the edges: null role or text is one space; null conv_id is a conversation of its own;
null turns come first; turns of one number follow by role, then by text; a role whose first letter
is none of s, u, a can't be kept; a conversation without turns has zeros and an empty audit; an
empty table gives an empty result; other columns are ignored. A conversation is one row of one
task, as the digest of its whole text asks; audits are copied at each turn.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: White space as words see it.
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL_PAIRS = ("su", "ua", "au")
_STATE = "struct<cost:bigint,audit:string,script:string>"


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32 of `conv_id:turn` modulo 20; gone marks a dropped turn, which still names its conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text, role = blank("text"), blank("role")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def faults(turns: DataFrame) -> DataFrame:
    """Adds fault (blank, duplicate, truncated or null) and seen, how many turns of the conversation up to this one have its role and text."""
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")
    seen = turns.withColumn("seen", F.row_number().over(same))
    fault = F.when(said == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated")
    return seen.withColumn("fault", fault)


def _add(state: Column, cost: Column | int, edit: Column | str, made: Column | str) -> Column:
    """A state with one more edit; null stays null, since it can't be reached."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    more = F.struct((state["cost"] + lit(cost)).cast("long").alias("cost"), F.concat(state["audit"], lit(edit)).alias("audit"), F.concat(state["script"], lit(made)).alias("script"))
    return F.when(state.isNotNull(), more)


def _inserted(s: Column) -> tuple[Column, Column]:
    """The states after u and after a when turns may be inserted; a second insertion is one after the first."""
    after_u = F.least(s["u"], *[_add(s[x], INSERT, "I", "u") for x in ("start", "s", "a")])
    return after_u, F.least(s["a"], _add(after_u, INSERT, "I", "a"))


def _step(s: Column, t: Column) -> Column:
    after_u, after_a = _inserted(s)
    more = F.when(t["fault"] == "truncated", TRUNCATED).otherwise(0)
    may_stay = t["fault"].isNull() | (t["fault"] == "truncated")
    initial = F.left(t["role"], F.lit(1))
    gone = lambda x: _add(x, DELETE, "D", "D")

    def stay(before: Column, wanted: str, made: str) -> Column:
        keep = initial == wanted
        return F.when(may_stay, _add(before, more + F.when(keep, 0).otherwise(REROLE), F.when(keep, "K").otherwise("R"), F.when(keep, "K").otherwise(made)))

    system = F.when(may_stay & (initial == "s"), _add(s["start"], more, "K", "K"))
    return F.struct(
        gone(s["start"]).alias("start"),
        F.least(gone(s["s"]), system).alias("s"),
        F.least(gone(after_u), stay(F.least(s["start"], s["s"], after_a), "u", "1")).alias("u"),
        F.least(gone(after_a), stay(after_u, "a", "2")).alias("a"),
    )


def cheapest(turns: Column) -> Column:
    """(cost, audit, script) of the cheapest repair of an array of turns with role and fault."""
    none, zero = F.lit(None).cast(_STATE), F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("script"))
    first = F.struct(zero.alias("start"), none.alias("s"), none.alias("u"), none.alias("a"))
    return F.aggregate(turns, first, _step, lambda s: F.least(s["start"], _inserted(s)[1]))


def _repaired(turns: Column, script: Column) -> Column:
    """The turns that a script leaves: what it inserts before each turn, the turn, and what it inserts at the end."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    empty = lambda made: F.transform(F.filter(F.split(made, ""), lambda c: c != ""), lambda c: turn(F.when(c == "u", "user").otherwise("assistant"), F.lit("")))

    def of(t: Column, made: Column) -> Column:
        own = F.right(made, F.lit(1))
        role = F.when(own == "1", "user").when(own == "2", "assistant").otherwise(t["role"])
        return F.concat(empty(F.rtrim(made, F.lit("DK12"))), F.when(own == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(turn(role, t["text"]))))

    each = F.zip_with(turns, F.regexp_extract_all(script, F.lit("[ua]*[DK12]"), F.lit(0)), of)
    return F.concat(F.flatten(each), empty(F.regexp_extract(script, "[ua]*$", 0)))


def repair(flagged: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), repaired an array of (role, text); one row a conversation."""
    there = ~F.col("gone")
    turns = F.sort_array(F.collect_list(F.when(there, F.struct("turn", "role", "text", "seen", "fault"))))
    counts = [F.count_if(there & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")]
    at = F.when(there, F.col("turn"))
    gaps = F.coalesce(F.max(at) - F.min(at) + 1 - F.size(F.collect_set(at)), F.lit(0)).cast("long")
    whole = flagged.groupBy("conv_id").agg(gaps.alias("gaps"), *counts, turns.alias("turns"))
    initials = F.transform("turns", lambda t: F.left(t["role"], F.lit(1)))
    pairs = F.zip_with(F.slice(initials, 1, F.greatest(F.size("turns") - 1, F.lit(0))), F.slice(initials, 2, F.size("turns")), lambda a, b: F.concat(a, b))
    legal = lambda p: reduce(Column.__or__, [p == x for x in LEGAL_PAIRS])
    whole = whole.withColumn("illegal", F.size(F.filter(pairs, lambda p: ~legal(p))).cast("long")).withColumn("best", cheapest(F.col("turns")))
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", _repaired(F.col("turns"), F.col("best.script")).alias("repaired"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repair(faults(damage(turns))).withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
