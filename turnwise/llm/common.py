"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from turnwise.session import stored  # noqa: F401

#: The bytes that separate words where a contract says ``[^\x20\x09-\x0D]+``; ``bytes.split()``
#: splits at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def set_aside(df: DataFrame, needed: Sequence[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``df`` with its columns but the ``needed`` ones under neutral names, and what gives the names back.

    No column that an operator makes on the way can then clash with one that is only carried along. The
    second value takes the operator's rows and the names of the columns that it adds; a carried column
    with the name of an added one, in either case, gives way to it.
    """
    columns = df.columns
    own = [c if c in needed else f"carried{i}" for i, c in enumerate(columns)]

    def restore(rows: DataFrame, *added: str) -> DataFrame:
        taken = {name.lower() for name in added}
        kept = [(o, c) for o, c in zip(own, columns) if c.lower() not in taken]
        return rows.select(*(o for o, _ in kept), *added).toDF(*(c for _, c in kept), *added)

    return df.toDF(*own), restore
