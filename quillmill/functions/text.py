"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, C.SPACES, " "))


def shortened(text: Column, limit: int) -> Column:
    """Collapsed text of at most ``limit`` characters, the last three dots where it is cut."""
    flat = collapsed(F.coalesce(text, F.lit("")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def trimmed(text: Column, limit: int) -> Column:
    """Text cut to ``limit`` characters, with a mark."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n...[truncated]"))).otherwise(text)


def head_tail(text: Column, head: int, tail: int, where: str = "omitted from search index") -> Column:
    """The first and last characters, and how many are left out between them."""
    return F.concat(F.substring(text, 1, head), F.lit("\n[... "), F.greatest(F.lit(0), F.length(text) - head - tail).cast("string"), F.lit(f" chars {where} ...]\n"), F.right(text, F.lit(tail)))


def is_blank(text: Column) -> Column:
    return collapsed(F.coalesce(text, F.lit(""))) == ""


def has_problem(text: Column) -> Column:
    """Whether a text speaks of an error."""
    return F.coalesce(F.lower(text).rlike("|".join(C.PROBLEM_WORDS)), F.lit(False))


def is_any(top: Column, sub: Column, pairs) -> Column:
    """Whether (top, sub) is one of the pairs; None in a pair stands for a null."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | ((top == a) & (sub.isNull() if b is None else sub.eqNullSafe(F.lit(b))))
    return F.coalesce(out, F.lit(False))
