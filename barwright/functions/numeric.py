"""Numeric column helpers whose NULL and rounding rules differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero divisor instead of failing under ANSI mode."""
    return F.try_divide(numerator, denominator)


def greatest_or_null(a: Column, b: Column) -> Column:
    """``greatest`` that is NULL when either side is (Spark's own skips NULLs)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def least_or_null(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def percent_change(new: Column, old: Column) -> Column:
    return safe_div(new - old, old) * 100


def to_number(col: Column) -> Column:
    """Coerce to double: text that is no number, NULL and NaN become 0."""
    return F.coalesce(F.nanvl(col.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def round_binary(col: Column, digits: int) -> Column:
    """Round the exact binary value half to even, as record types in the serving layer do.

    ``round`` works on the shortest decimal form (1.005 becomes 1.01); ``format_number`` resolves ties on the
    exact value (1.005 is below the tie and becomes 1.0).
    """
    return F.call_function("format_number", col, F.lit("0." + "0" * digits)).cast("double")


def round_scaled(col: Column, digits: int) -> Column:
    """Round the scaled double half to even, as a database ROUND on doubles does."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale
