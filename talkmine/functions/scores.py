"""Scores, grades and their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DIMENSIONS, GRADE_LABEL, GRADE_LINES, GRADE_RANK


def weighted(dims: dict[str, Column] | None = None) -> Column:
    """The five sub-scores (1 to 10; null: 5) by weight, 0 to 100 with one decimal."""
    own = dims or {k: F.col(k) for k in DIMENSIONS}
    total = F.lit(0)
    for k, w in DIMENSIONS.items():
        total = total + F.coalesce(own[k].cast("int"), F.lit(5)) * w
    return total.cast("double") / 10


def grade(score: Column, missing: str = "D") -> Column:
    out = F.when(score.isNull(), missing)
    for letter, line in GRADE_LINES:
        out = out.when(score >= line, letter)
    return out.otherwise("D")


def _choice(value: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(default)


def rank(letter: Column) -> Column:
    return _choice(letter, GRADE_RANK, 9)


def tier(letter: Column) -> Column:
    return _choice(letter, {"S": "S", "A": "A", "B": "B_fill", "C": "C_fallback"}, "")


def label(letter: Column) -> Column:
    return _choice(letter, GRADE_LABEL, "")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap as a share of the shorter span, at most 1; 0 where they don't overlap or a
    time is missing."""
    both = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    known = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    shorter = F.least(a_end - a_start, b_end - b_start)
    return F.when(known & (both > 0), F.least(F.lit(1.0), both / shorter)).otherwise(F.lit(0.0))


def time_decay(gap: Column, window: float) -> Column:
    return F.when(gap.isNull() | F.lit(window <= 0), 0.0).when(gap <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - gap / F.lit(float(window))))


def thousandths(x: Column) -> Column:
    """Three decimals, halves up even where the binary value lies a little under one."""
    return F.floor(x * 1000 + 0.500000001) / 1000
