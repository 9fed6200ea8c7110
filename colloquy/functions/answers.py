"""Answer extraction, normalization and wrong answers as columns."""

from __future__ import annotations

import random

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns must match as listed, first pattern first, for right results. Case is ignored.
YES_NO = (
    r"final answer:?\s*(Yes|No)",
    r"answer:?\s*(Yes|No)",
    r"the answer is\s*(Yes|No)",
    r"I (?:think|believe) (?:the answer is )?(Yes|No)",
)
YES_NO_WORD = r"\b(Yes|No)\b"
CHOICE = (
    r"final answer:?\s*\(?([A-D])\)?",
    r"answer:?\s*\(?([A-D])\)?",
    r"\(([A-D])\)",
    r"option\s*([A-D])",
    r"choice\s*([A-D])",
    r"the (?:correct )?(?:answer|option) is\s*\(?\s*([A-D])\s*\)?",
    r"\b([A-D])\b(?=[.,;:]?\s*$|\s*(?:is|\.))",
)
FLAGS = "(?iU)"
#: The first 32-bit draws under seed 42. choice() among n takes the first draw whose upper bit_length(n) bits are below n; a draw
#: misses with a probability of a half at most. A test holds n up to 300 against random.
_SEEDED = random.Random(42)
DRAWS = [_SEEDED.getrandbits(32) for _ in range(64)]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, FLAGS + pattern, 1), F.lit(""))


def extract_yes_no(text: Column) -> Column:
    """YES or NO: ordered patterns, then the last whole word; null if none."""
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(FLAGS + YES_NO_WORD), F.lit(1)), F.lit(-1))
    return F.upper(F.coalesce(*[_first(text, p) for p in YES_NO], last))


def extract_choice(text: Column) -> Column:
    return F.upper(F.coalesce(*[_first(text, p) for p in CHOICE]))


def extract_answer(text: Column, task_type: Column) -> Column:
    choice, yes_no = extract_choice(text), extract_yes_no(text)
    return F.when(task_type == "yes_no", yes_no).when(task_type == "multiple_choice", choice).when(task_type == "mixed", F.coalesce(choice, yes_no))


def normalize_answer(answer: Column) -> Column:
    """White space, then parentheses, then full stops stripped; upper case; first character."""
    bare = F.btrim(F.btrim(strip(F.coalesce(answer, F.lit(""))), F.lit("()")), F.lit("."))
    return F.substring(F.upper(bare), 1, 1)


#: Choices up to which the place of the drawn one is looked up; beyond it is drawn.
LOOKED_UP = 256


def _place(n: int) -> int:
    """The index that choice() takes among n."""
    return next((x >> (32 - n.bit_length()) for x in DRAWS if x >> (32 - n.bit_length()) < n), -1)


_PLACES = [_place(n) for n in range(1, LOOKED_UP + 1)]


def wrong_answer(correct: Column, choices: Column) -> Column:
    """No for yes and yes for no; else the seeded choice among choices that are not the correct one, in upper case; else among other letters."""
    low = F.lower(correct)
    others = F.filter(choices, lambda c: F.upper(c) != F.upper(correct))
    letters = F.filter(F.array(*map(F.lit, "ABCD")), lambda c: c != F.upper(correct))
    pool = F.when(F.size(others) > 0, others).otherwise(letters)
    unused = F.lit(32) - F.length(F.bin(F.size(pool)))
    upper = F.transform(F.array(*[F.lit(x).cast("long") for x in DRAWS]), lambda x: F.call_function("shiftright", x, unused).cast("int"))
    drawn = F.get(F.filter(upper, lambda i: i < F.size(pool)), F.lit(0))
    looked_up = F.get(F.array(*map(F.lit, _PLACES)), F.size(pool) - 1)
    index = F.when(F.size(pool) <= LOOKED_UP, looked_up).otherwise(drawn)
    return F.when(low == "yes", "no").when(low == "no", "yes").otherwise(F.upper(F.get(pool, index)))


def detect_model_type(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.contains("llama"), "llama3")
    for kind in ("mistral", "gemma", "qwen"):
        out = out.when(low.contains(kind), kind)
    return out.otherwise("llama3")
