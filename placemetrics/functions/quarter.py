"""Quarter arithmetic as Column expressions.

A quarter is a ``YYYYQ`` string at the edges and ``year*4 + quarter-1`` (the *index*)
inside jobs, so that lags, ranges and frames are plain integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUARTER_PATTERN = r"^\d{4}[1-4]$"


def quarter_idx(code: Column) -> Column:
    """Index of a ``YYYYQ`` code, null when the code is not a quarter."""
    c = F.trim(code)
    value = c.substr(1, 4).cast("int") * 4 + c.substr(5, 1).cast("int") - 1
    return F.when(c.rlike(QUARTER_PATTERN), value)


def quarter_code(idx: Column) -> Column:
    return F.concat(F.floor(idx / 4).cast("string"), (F.pmod(idx, F.lit(4)) + 1).cast("string"))


def shift_quarter(code: Column, offset: int | Column) -> Column:
    return quarter_code(quarter_idx(code) + offset)


def quarter_of_date(ts: Column) -> Column:
    """Index of the quarter that holds a date or timestamp."""
    return F.year(ts) * 4 + F.quarter(ts) - 1


def quarter_at(ts: Column, offset_hours: int = 9) -> Column:
    """Index of the quarter of an instant on a clock ``offset_hours`` ahead of UTC."""
    return quarter_of_date(ts + F.expr(f"INTERVAL {offset_hours} HOURS"))


def quarters_between(start_idx: Column, end_idx: Column) -> Column:
    """Inclusive array of indexes, oldest first; empty when start is after end."""
    return F.when(start_idx > end_idx, F.array().cast("array<int>")).otherwise(
        F.sequence(start_idx.cast("int"), end_idx.cast("int")))


def quarter_label(idx: Column) -> Column:
    return F.concat(F.floor(idx / 4).cast("string"), F.lit("년 "),
                    (F.pmod(idx, F.lit(4)) + 1).cast("string"), F.lit("분기"))


def period_label(start_idx: Column, end_idx: Column) -> Column:
    """``2024년 1분기~4분기`` inside one year, both years spelled out otherwise."""
    same_year = F.floor(start_idx / 4) == F.floor(end_idx / 4)
    tail = F.concat((F.pmod(end_idx, F.lit(4)) + 1).cast("string"), F.lit("분기"))
    return F.concat(quarter_label(start_idx), F.lit("~"),
                    F.when(same_year, tail).otherwise(quarter_label(end_idx)))


def period_code(start_idx: Column, end_idx: Column) -> Column:
    def part(i: Column) -> Column:
        return F.concat(F.floor(i / 4).cast("string"), F.lit("Q"), (F.pmod(i, F.lit(4)) + 1).cast("string"))
    return F.concat(part(start_idx), F.lit("-"), part(end_idx))
