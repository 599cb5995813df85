"""Arithmetic with the null and rounding rules the results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, places: int) -> Column:
    """Round to ``places`` decimals, halves to the even neighbour (array-library rounding)."""
    scale = float(10**places)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def at_least(value: Column, floor) -> Column:
    """Row maximum of a column and a constant; null stays null (``greatest`` alone would drop it)."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def ratio_or_null(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def present(value: Column) -> Column:
    """Neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def known(value: Column) -> Column:
    """The value, null where it is NaN."""
    return F.when(present(value), value)


def money_sum(value: Column) -> Column:
    """Sum of amounts in cents-exact decimals: the same result in any row order."""
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))
