"""Exact money arithmetic: integers in, one half-up rounding out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def int_div(a: Column, b: Column) -> Column:
    """Floor quotient of non-negative integers held as DECIMAL(38,0) or BIGINT."""
    return F.call_function("div", a, b)


def half_up_div(num: Column, den: Column) -> Column:
    """``num / den`` rounded half up away from zero to an integer (BIGINT), ``den`` > 0.

    Everything stays integral: ``(2|n| + d) div (2d)`` with the sign put back, so no
    decimal scale is lost. Null when an input is null or the divisor is zero.
    """
    n, d = wide(num), wide(den)
    q = int_div(F.abs(n) * 2 + d, d * 2)
    return F.when(d == 0, F.lit(None).cast("bigint")).when(n < 0, -q).otherwise(q)


def cents(amount: Column) -> Column:
    """Integer cents of a DOUBLE amount; sums of it do not depend on row order."""
    return F.round(amount * 100).cast("bigint")


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once per row instead of once per mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
