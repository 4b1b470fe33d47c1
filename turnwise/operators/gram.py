"""Cross moments of a design matrix: the one pass over the rows that all linear fits share.

A moment matrix is (p+2)×(p+2): the products of [1, x₁ … x_p, y] with itself. It is the only thing
a fit needs, so folds, penalties and feature subsets never rescan the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPRESSION_COLUMNS = 12
MERGE_PARTS = 32


def complete_rows(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """Rows with neither null nor NaN in any used column. Columns that can hold neither, such as
    the 0/1 columns of a one-hot matrix, are not tested: a pushed-down test would evaluate their
    expressions a second time."""
    tested = [
        c
        for c in dict.fromkeys([*xs, y])
        if df.schema[c].nullable or isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    ]
    return df.na.drop(subset=tested) if tested else df


def gram(df: DataFrame, xs: Sequence[str], y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, moments): one row per key with its flattened moment matrix.

    Few columns are summed as expressions. Many are multiplied batch by batch in NumPy; a task
    emits one matrix per key, and the matrices are added up in two rounds.
    """
    keys = list(keys)
    rows = complete_rows(df, xs, y).select(
        *keys, *[F.col(c).cast("double").alias(c) for c in [*xs, y]]
    )
    if len(xs) + 2 <= EXPRESSION_COLUMNS:
        return _gram_expressions(rows, xs, y, keys)
    return _gram_blocks(rows, xs, y, keys)


def _gram_expressions(rows: DataFrame, xs: Sequence[str], y: str, keys: list[str]) -> DataFrame:
    terms = [F.lit(1.0), *[F.col(c) for c in xs], F.col(y)]
    size = len(terms)
    sums = {
        (i, j): F.sum(terms[i] * terms[j]).alias(f"_{i}_{j}")
        for i in range(size)
        for j in range(i, size)
    }
    summed = rows.groupBy(*keys).agg(*sums.values())
    flat = [F.col(f"_{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size)]
    return summed.filter(F.col("_0_0") > 0).select(
        *keys, F.col("_0_0").cast("bigint").alias("n"), F.array(*flat).alias("moments")
    )


def _gram_blocks(rows: DataFrame, xs: Sequence[str], y: str, keys: list[str]) -> DataFrame:
    columns = [*xs, y]
    size = len(columns) + 1

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            parts = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for key, part in parts:
                block = np.empty((len(part), size))
                block[:, 0] = 1.0
                block[:, 1:] = part[columns].to_numpy(float)
                product = block.T @ block
                sums[key] = sums[key] + product if key in sums else product
        out = pd.DataFrame([[*key, m.ravel()] for key, m in sums.items()], columns=[*keys, "moments"])
        yield out

    schema = T.StructType(
        [rows.schema[k] for k in keys] + [T.StructField("moments", T.ArrayType(T.DoubleType()))]
    )
    partial = rows.mapInPandas(multiply, schema).withColumn(
        "_part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))
    )
    added = Summarizer.sum(array_to_vector("moments")).alias("_sum")
    first = partial.groupBy(*keys, "_part").agg(added).withColumn("moments", vector_to_array("_sum"))
    merged = first.groupBy(*keys).agg(added).withColumn("moments", vector_to_array("_sum"))
    return merged.filter(F.col("moments").isNotNull()).select(
        *keys, F.get("moments", F.lit(0)).cast("bigint").alias("n"), "moments"
    )


def gram_long(moments: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """Named cells (keys, left, right, value) of the matrices."""
    names = ["1", *xs, y]
    size = len(names)
    listed = F.array(*[F.lit(n) for n in names])
    return moments.select(*keys, F.posexplode("moments").alias("_at", "value")).select(
        *keys,
        F.element_at(listed, (F.floor(F.col("_at") / size) + 1).cast("int")).alias("left"),
        F.element_at(listed, (F.col("_at") % size + 1).cast("int")).alias("right"),
        "value",
    )


def merge(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matrices of several folds added up per key."""
    added = Summarizer.sum(array_to_vector("moments")).alias("_sum")
    return moments.groupBy(*keys).agg(F.sum("n").alias("n"), added).select(
        *keys, "n", vector_to_array("_sum").alias("moments")
    )


def contiguous_matrix(flat) -> np.ndarray:
    values = np.asarray(flat, float)
    size = int(round(len(values) ** 0.5))
    return values.reshape(size, size)
