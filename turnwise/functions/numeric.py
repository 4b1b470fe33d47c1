"""Arithmetic that yields null, not an error, where it is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent_change(new: Column, old: Column) -> Column:
    return ratio((new - old) * 100, old)


def clean(value: Column) -> Column:
    """NaN as null: Spark averages propagate NaN, and a missing value should be skipped."""
    return F.when(~F.isnan(value), value)
