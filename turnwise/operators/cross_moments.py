"""Cross moments of a design with any number of levels, from one pass over the rows.

A row has numeric columns, an outcome and categorical columns. Its one-hot matrix is never built: a task adds
up the products of the numeric columns, for each level its rows and their numeric sums, and for each two
levels that meet the rows they meet in. These sums are the sparse cross-moment matrix; they add up over
tasks, folds and analyses. Means, scaling, level lists and the dense matrix of a fit follow from them without
another scan.

Numeric columns enter as differences from a row near their middle (the median of the first rows), the same
in all tasks, so that large means cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.operators.gram import MERGE_PARTS, complete_rows
from turnwise.operators.reshape import dummy_name
from turnwise.session import cut_lineage

#: First rows whose medians the differences are taken from.
MIDDLE_ROWS = 1000
#: Level sums that a task holds before it hands them over.
HELD_SUMS = 1 << 22


@dataclass
class CrossMoments:
    """``cells``: (keys, left, right, values). Without names the products of [1, numeric …, outcome]; with a
    left name a level's rows and sums of these; with both the rows in which two levels meet."""

    cells: DataFrame
    keys: list[str]
    numeric: list[str]
    categorical: list[str]
    outcome: str
    middle: np.ndarray


def cross_moments(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], outcome: str, keys: Sequence[str] = (),
) -> CrossMoments:
    """Sums over the rows that have all numeric columns and the outcome; a null level is none."""
    keys, numeric, categorical = list(keys), list(numeric), list(categorical)
    measured = [*numeric, outcome]
    rows = complete_rows(df, numeric, outcome).select(
        *keys, *(F.col(c).cast("string").alias(c) for c in categorical), *(F.col(c).cast("double").alias(c) for c in measured)
    )
    first = np.array([[row[c] for c in measured] for row in rows.select(*measured).limit(MIDDLE_ROWS).collect()], float)
    middle = np.median(first, axis=0) if len(first) else np.zeros(len(measured))
    schema = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("left string, right string, values array<double>").fields])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        held, types = 0, []

        def out() -> pa.RecordBatch:
            cells = list(sums)
            arrays = [pa.array([cell[i] for cell in cells], t) for i, t in enumerate(types)]
            arrays += [pa.array([cell[len(keys) + i] for cell in cells], pa.string()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(list(sums.values()), pa.list_(pa.float64()))], schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            types = batch.schema.types[: len(keys)]
            block = np.ones((batch.num_rows, len(measured) + 1))
            for i, name in enumerate(measured):
                block[:, i + 1] = batch.column(name).to_numpy(zero_copy_only=False) - middle[i]
            coded = [batch.column(name).dictionary_encode() for name in categorical]
            names = [[dummy_name(c, v) for v in x.dictionary.to_pylist()] for c, x in zip(categorical, coded)]
            codes = [x.indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in coded]
            for key, at in _groups([batch.column(i) for i in range(len(keys))], batch.num_rows):
                own = block[at]
                held += _add(sums, (*key, None, None), (own.T @ own).ravel())
                for i, of in enumerate(codes):
                    order = np.argsort(of[at], kind="stable")
                    levels, starts = np.unique(of[at][order], return_index=True)
                    for level, total in zip(levels.tolist(), np.add.reduceat(own[order], starts)):
                        if level >= 0:
                            held += _add(sums, (*key, names[i][level], None), total)
                    for j in range(i + 1, len(codes)):
                        both = of[at].astype(np.int64) * (len(names[j]) + 1) + codes[j][at] + 1
                        for pair, n in zip(*(x.tolist() for x in np.unique(both, return_counts=True))):
                            a, b = divmod(pair, len(names[j]) + 1)
                            if a >= 0 and b > 0:
                                held += _add(sums, (*key, names[i][a], names[j][b - 1]), np.array([float(n)]))
            if held > HELD_SUMS:
                yield out()
                sums.clear()
                held = 0
        if sums:
            yield out()

    partial = rows.mapInArrow(add_up, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    added = Summarizer.sum(array_to_vector("values")).alias("_sum")
    cells = [*keys, "left", "right"]
    parts = partial.groupBy(*cells, "_part").agg(added).withColumn("values", vector_to_array("_sum"))
    merged = parts.groupBy(*cells).agg(added).select(*cells, vector_to_array("_sum").alias("values"))
    return CrossMoments(cut_lineage(merged), keys, numeric, categorical, outcome, middle)


def _add(sums: dict[tuple, np.ndarray], cell: tuple, more: np.ndarray) -> int:
    """Add to a cell; how many numbers are new."""
    if cell in sums:
        sums[cell] = sums[cell] + more
        return 0
    sums[cell] = more
    return more.size


def _groups(keys: Sequence[pa.Array], n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Keys and the rows that have them."""
    if not keys:
        yield (), np.arange(n)
        return
    codes = np.zeros(n, np.int64)
    for array in keys:
        own = array.dictionary_encode("encode")
        codes = codes * len(own.dictionary) + own.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        yield tuple(array[int(at[0])].as_py() for array in keys), at


def feature_names(cross: CrossMoments) -> list[str]:
    """Numeric columns, then the levels of each categorical column in order: the columns of a fit."""
    rows = cross.cells.filter(F.col("left").isNotNull() & F.col("right").isNull()).select("left").distinct().collect()
    known = sorted(row[0] for row in rows)
    names = list(cross.numeric)
    for column in cross.categorical:
        prefix = dummy_name(column, "")
        longer = [dummy_name(c, "") for c in cross.categorical if c != column and dummy_name(c, "").startswith(prefix)]
        names += [x for x in known if x.startswith(prefix) and not any(x.startswith(p) for p in longer)]
    return names


def dense_moments(cross: CrossMoments, xs: Sequence[str], by: Sequence[str] = (), scale: bool = True) -> DataFrame:
    """(keys, n, moments) as ``gram`` has them, for the columns ``xs``: one matrix for each key.

    With ``scale`` the numeric columns have mean 0 and deviation 1 over all rows of ``by`` (a part of the
    keys); a constant one is 0. Otherwise they are as they came. The outcome is a difference from
    ``middle[-1]``, which ``with_intercept`` gives back.
    """
    by, xs, keys = list(by), list(xs), cross.keys
    size = len(cross.numeric) + 2
    used = [i + 1 for i, name in enumerate(cross.numeric) if name in xs]
    own = cross.cells.filter(F.col("left").isNull())
    total: dict[tuple, np.ndarray] = {}
    for row in own.select(*by, "values").collect():
        at = tuple(row[k] for k in by)
        total[at] = total.get(at, 0) + np.array(row["values"]).reshape(size, size)
    change: dict[tuple, np.ndarray] = {}
    for at, sums in total.items():
        mean = sums[0] / sums[0, 0]
        spread = np.sqrt(np.maximum(np.diag(sums) / sums[0, 0] - mean**2, 0))
        matrix = np.eye(size)
        for i in range(1, size - 1):
            if scale:
                constant = spread[i] <= 1e-12 * max(1.0, abs(mean[i]))
                matrix[i, i] = 1.0 if constant else 1 / spread[i]
                matrix[i, 0] = -mean[i] * matrix[i, i]
            else:
                matrix[i, 0] = cross.middle[i - 1]
        change[at] = matrix
    place = {name: i + 1 for i, name in enumerate(xs)}
    position = [0, *(place[cross.numeric[i - 1]] for i in used), len(xs) + 1]
    kept = [0, *used, size - 1]

    def assemble(table: pa.Table) -> pa.Table:
        at = tuple(table.column(k)[0].as_py() for k in by)
        matrix = change[at]
        dense = np.zeros((len(xs) + 2, len(xs) + 2))
        for left, right, values in zip(*(table.column(c) for c in ("left", "right", "values"))):
            left, right, values = left.as_py(), right.as_py(), values.values.to_numpy()
            if left is None:
                dense[np.ix_(position, position)] = (matrix @ values.reshape(size, size) @ matrix.T)[np.ix_(kept, kept)]
            elif left not in place or (right is not None and right not in place):
                continue
            elif right is None:
                row = place[left]
                dense[row, position] = dense[position, row] = (matrix @ values)[kept]
                dense[row, row] = values[0]
            else:
                dense[place[left], place[right]] = dense[place[right], place[left]] = values[0]
        found = [pa.array([int(dense[0, 0])], pa.int64()), pa.array([dense.ravel()], pa.list_(pa.float64()))]
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), *found], [*keys, "n", "moments"])

    schema = StructType([*(cross.cells.schema[k] for k in keys), *StructType.fromDDL("n bigint, moments array<double>").fields])
    return cross.cells.groupBy(*keys).applyInArrow(assemble, schema)


def with_intercept(fits: DataFrame, cross: CrossMoments) -> DataFrame:
    """Fits of the shifted outcome as fits of the outcome."""
    return fits.withColumn("intercept", F.col("intercept") + F.lit(float(cross.middle[-1])))
