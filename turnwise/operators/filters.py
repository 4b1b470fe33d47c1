"""Row filters and recodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.config import CONTRASTS, CONTRASTS_BY_SUBSTRING, OUTLIER_TOPIC, UNKNOWN_MARKERS


def known(df: DataFrame, column: str, markers: Sequence[str] = UNKNOWN_MARKERS) -> DataFrame:
    """Rows whose value is neither null nor a marker for a missing one."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*markers))


def differs(column: Column, value) -> Column:
    """Inequality that keeps null rows."""
    return ~column.eqNullSafe(F.lit(value))


def without_outliers(df: DataFrame, topic: str = "topic", marker: str = OUTLIER_TOPIC) -> DataFrame:
    return df.filter(differs(F.col(topic), marker))


def text_contains(column: Column, part: str) -> Column:
    return F.coalesce(F.contains(column, F.lit(part)), F.lit(False))


def min_group_size(df: DataFrame, keys: Sequence[str], size: int = 2) -> DataFrame:
    """Rows whose key occurs at least ``size`` times.

    Counting is pre-aggregated and the rows are then semi-joined, so a hot key is never one window.
    """
    large = df.groupBy(*keys).count().filter(F.col("count") >= size)
    large = large.select(*[F.col(k).alias(f"_{k}") for k in keys])
    matches = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = matches[0]
    for match in matches[1:]:
        condition = condition & match
    return df.join(large, condition, "left_semi")


def recode(column: Column, mapping: Mapping) -> Column:
    """Mapped values replaced, all others kept."""
    result = column
    for old, new in mapping.items():
        result = F.when(column == F.lit(old), F.lit(new)).otherwise(result)
    return result


def contrast(column: Column, zeros: Sequence, ones: Sequence, by_substring: bool = False) -> Column:
    """0, 1, or null for a value on neither list."""
    if by_substring:
        hit = lambda values: [text_contains(column, v) for v in values]
        is_zero, is_one = F.lit(False), F.lit(False)
        for match in hit(zeros):
            is_zero = is_zero | match
        for match in hit(ones):
            is_one = is_one | match
    else:
        is_zero, is_one = column.isin(*zeros), column.isin(*ones)
    return F.when(is_zero, 0).when(is_one, 1)


def binarize(df: DataFrame, column: str, rules: Mapping[str, tuple] | None = None) -> DataFrame:
    """The demographic as a 0/1 contrast; rows outside the contrast are dropped."""
    zeros, ones = (rules or CONTRASTS)[column]
    coded = contrast(F.col(column), zeros, ones, by_substring=column in CONTRASTS_BY_SUBSTRING)
    return df.withColumn(column, coded).filter(F.col(column).isNotNull())
