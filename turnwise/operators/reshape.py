"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LEVELS = 2000


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def unpivot_demographics(df: DataFrame, ids: Sequence[str], demographics: Sequence[str]) -> DataFrame:
    """One row per input row and demographic, as (demo, group): all demographics in one job."""
    return df.unpivot(list(ids), list(demographics), "demo", "group")


def levels(df: DataFrame, column: str, limit: int = MAX_LEVELS) -> list:
    """The sorted distinct values that will name columns. Past the limit a wide table is the wrong
    shape, and the long operators (``counts``, ``dummies_long``) take any number."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} levels; use the long form")
    return sorted(r[0] for r in rows)


def counts(df: DataFrame, keys: Sequence[str], into: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(into))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    """Counts with one column per value; absent combinations are 0."""
    values = levels(df, column) if values is None else list(values)
    return (
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row)
        .pivot(column, values)
        .count()
        .na.fill(0)
    )


def questions_to_columns(answers: DataFrame, keys: Sequence[str], question: str, value: Column, values: Sequence) -> DataFrame:
    """Long answers to one column per question."""
    return answers.groupBy(*keys).pivot(question, list(values)).agg(value)


def questions_to_rows(df: DataFrame, keys: Sequence[str], prefix: str = "q_") -> DataFrame:
    asked = [c for c in df.columns if c.startswith(prefix)]
    return df.unpivot(list(keys), asked, "q_id", "answer")


def dummy_name(column: str, level) -> str:
    return f"dummy_{column}_{level}"


def dummies(df: DataFrame, columns: Sequence[str], levels_of: dict[str, Sequence] | None = None) -> DataFrame:
    """One 0/1 column per level of each column, which it replaces; null is 0 in all of them."""
    levels_of = levels_of or {c: levels(df, c) for c in columns}
    coded = {
        dummy_name(c, level): F.when(F.col(c) == F.lit(level), 1).otherwise(0)
        for c in columns
        for level in levels_of[c]
    }
    return df.select(
        *[c for c in df.columns if c not in columns],
        *[expr.alias(name) for name, expr in coded.items()],
    )


def dummies_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The ones of the one-hot matrix as rows (ids, feature), for any number of levels."""
    return (
        df.select(*ids, *[F.col(c).cast("string") for c in columns])
        .unpivot(list(ids), list(columns), "column", "level")
        .filter(F.col("level").isNotNull())
        .select(*ids, F.concat(F.lit("dummy_"), "column", F.lit("_"), "level").alias("feature"))
    )


def flatten_scores(df: DataFrame, ids: Sequence[str], arrays: Sequence[str], position: str = "cv") -> DataFrame:
    """Aligned score arrays to one row per position."""
    zipped = F.arrays_zip(*arrays)
    return df.select(*ids, F.posexplode(zipped).alias(position, "_scores")).select(
        *ids, position, *[F.col(f"_scores.{a}").alias(a) for a in arrays]
    )
