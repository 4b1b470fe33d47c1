"""Columns picked out of structs and out of sibling columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_or_default(struct: Column, field: str, default) -> Column:
    """The field, or the default where the struct itself is null; a null field stays null."""
    return F.when(struct.isNotNull(), struct[field]).otherwise(F.lit(default))


def pick_by_label(label: Column, options: Mapping[str, Column]) -> Column:
    """The option named by the last character of the label; null for a null or unknown label."""
    suffix = F.right(label, F.lit(1))
    picked = F.lit(None)
    for letter, option in options.items():
        picked = F.when(suffix == letter, option).otherwise(picked)
    return picked


def simplify_survey(df: DataFrame, default: str = "Prefer not to say") -> DataFrame:
    """Nested survey answers as flat columns."""
    return df.withColumns(
        {
            "religion": field_or_default(F.col("religion"), "simplified", default),
            "ethnicity": field_or_default(F.col("ethnicity"), "simplified", default),
            "birth_region": field_or_default(F.col("location"), "birth_region", default),
            "reside_region": field_or_default(F.col("location"), "reside_region", default),
        }
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType)]


def select_features(df: DataFrame, containing: Sequence[str], keep: Sequence[str] = (), excluding: Sequence[str] = ()) -> DataFrame:
    """Kept columns plus every column whose name contains one of the substrings."""
    return df.select(
        *[
            c
            for c in df.columns
            if c in keep or (any(s in c for s in containing) and c not in excluding)
        ]
    )


def drop_prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def prefixed(df: DataFrame, prefix: str, except_for: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: prefix + c for c in df.columns if c not in except_for})
