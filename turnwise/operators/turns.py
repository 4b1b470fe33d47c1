"""Turn operators on long tables (one row per conversation and turn)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.ordered import Carry, in_ranges, same_as_before, scan_in_order


def _differs(carry: Carry, starts: np.ndarray, key: tuple[pa.Array, ...], roles: pa.Array) -> tuple[np.ndarray, object]:
    """Whether a row's role is another one than that of the key's row before; the first has none before."""
    known = roles.is_valid().to_numpy(zero_copy_only=False)
    same = np.append(False, same_as_before(roles))
    same[0] = roles[0].as_py() == carry.value
    return np.where(starts, known, ~same), roles[-1].as_py()


def _still(carry: Carry, starts: np.ndarray, key: tuple[pa.Array, ...], present: pa.Array) -> tuple[np.ndarray, object]:
    """Whether the flag holds in this row and in all rows of the key before it."""
    missing = np.cumsum(~present.to_numpy(zero_copy_only=False))
    first = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), -1))
    before = np.where(first > 0, missing[np.maximum(first - 1, 0)], 0)
    still = missing == before
    if carry.value is False:
        still &= first >= 0
    return still, bool(still[-1])


def collapse_same_role(
    df: DataFrame, conversation: str = "conversation_id", turn: str = "turn", role: str = "role",
) -> DataFrame:
    """Keep the first turn of every run of one role; the comparison is to the original neighbour. A first turn
    without a role is dropped."""
    ranges = in_ranges(df, [conversation], turn)
    kept = scan_in_order(ranges, [conversation], F.col(role), "_kept", _differs, lambda before, own, one_key: own.value)
    return kept.filter("_kept").select(*df.columns)


def until_first_missing(
    df: DataFrame, present: Column, conversation: str = "conversation_id", turn: str = "turn",
) -> DataFrame:
    """The turns before the first one that lacks a value."""
    flagged = df.withColumn("_present", F.coalesce(present, F.lit(False)))

    def hand_on(before: Carry, own: Carry, one_key: bool) -> bool:
        # Only where the range is one key can rows of that key lie in the ranges before.
        return own.value and not (one_key and before.key == own.key and before.value is False)

    kept = scan_in_order(
        in_ranges(flagged, [conversation], turn), [conversation], F.col("_present"), "_kept", _still, hand_on
    )
    return kept.filter("_kept").select(*df.columns)


def nest_turns(
    df: DataFrame, conversation: str = "conversation_id", turn: str = "turn",
    fields: Sequence[str] = ("role", "content"),
) -> DataFrame:
    """One row per conversation with its turns as an ordered array: the shape prompts are built
    from, so one conversation is one value by definition."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("_turn"), *fields)))
    return df.groupBy(conversation).agg(
        F.transform(ordered, lambda t: F.struct(*[t[f].alias(f) for f in fields])).alias("turns")
    )


def chosen_first(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chosen: Column
) -> DataFrame:
    """Per key and column the first non-null value among the chosen rows, in the given order."""
    return (
        df.filter(chosen)
        .groupBy(*keys)
        .agg(
            *[
                F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
                for c in columns
            ]
        )
    )


def unpivot_aligned(
    df: DataFrame, ids: Sequence[str], families: Mapping[str, Mapping[str, str]], name: str = "turn",
    required: str | None = None,
) -> DataFrame:
    """Several column families to rows at once: ``{turn: {field: column}}`` yields one row per
    turn, so four turns make four rows per input row."""
    rows = F.array(
        *[
            F.struct(
                F.lit(label).alias(name), *[F.col(c).alias(field) for field, c in fields.items()]
            )
            for label, fields in families.items()
        ]
    )
    long = df.select(*ids, F.inline(rows))
    return long if required is None else long.filter(F.col(required).isNotNull())
