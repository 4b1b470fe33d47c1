"""Almost stochastic order of two samples (del Barrio et al. 2018; Dror et al. 2019).

The score bounds from above the share of the squared quantile distance on which the first sample
is the smaller one; below one half the first sample is almost stochastically larger. Samples enter
as value histograms. A bootstrap quantile of a sample of size n is the sample's value at rank
ceil(n·U), where U is a uniform order statistic, so replicates draw ranks, not rows.

A histogram is cut into ranges of values. The task that holds a range draws all ranks of its sample (a
seed makes them the same everywhere), keeps those that fall into the range and looks their values up
in its cumulated counts. What meets in one task per analysis are two arrays of replicates × grid points,
whatever the size of the samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.operators.aggregates import null_safe_join
from turnwise.operators.ordered import SEGMENT, by_value, value_buckets
from turnwise.session import cut_lineage

#: Distinct values of all samples that fall into one range.
RANGE_VALUES = 1 << 19


def _positions(n: int, dt: float) -> np.ndarray:
    grid = np.arange(dt, 1, dt)
    return np.clip(np.ceil(n * grid - 1e-9), 1, n).astype(np.int64)


def draw_ranks(n: int, dt: float, replicates: int, seed: int) -> np.ndarray:
    """Ranks per replicate and grid point; row 0 holds those of the sample itself."""
    own = _positions(n, dt)
    rng = np.random.default_rng(seed)
    distinct, where = np.unique(own, return_inverse=True)
    steps = np.diff(np.concatenate([[0], distinct]))
    gaps = rng.gamma(steps, size=(replicates, len(steps)))
    total = gaps.sum(axis=1) + rng.gamma(n + 1 - distinct[-1], size=replicates)
    uniform = np.cumsum(gaps, axis=1) / total[:, None]
    drawn = np.clip(np.ceil(n * uniform), 1, n).astype(np.int64)[:, where]
    return np.vstack([own[None, :], drawn])


def violation(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Violation ratio along the last axis; equal samples count as undecided."""
    gap = second - first
    square = (gap**2).sum(axis=-1)
    above = (np.maximum(gap, 0) ** 2).sum(axis=-1)
    return np.where(square > 0, above / np.where(square > 0, square, 1), 0.5)


def aso(
    df: DataFrame, by: Sequence[str], first: str, second: str, seed: int = 0, confidence: float = 0.95,
    dt: float = 0.005, replicates: int = 1000, weight: str | None = None,
) -> DataFrame:
    """Score per analysis for the columns ``first`` and ``second``. An analysis without a value on
    either side is left out; null keys are a key. ``weight``: how many rows a row stands for."""
    by = list(by)
    count = F.lit(1) if weight is None else F.col(weight)
    long = df.select(
        *by, F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b"),
        count.cast("bigint").alias("_c"),
    )
    values = long.unpivot([*by, "_c"], ["a", "b"], "_side", "_v").filter(F.col("_v").isNotNull())
    histogram = cut_lineage(
        values.groupBy(*by, "_side", "_v").agg(F.sum("_c").alias("_c"))
    )
    looked_up = _quantiles(_ranged(histogram, [*by, "_side"], seed), by, dt, replicates)
    z = NormalDist().inv_cdf(1 - confidence)
    score = F.col("violation") - F.col("_spread") * z
    return _violations(looked_up, by, dt, replicates).select(
        *by, "n_first", "n_second", "violation",
        F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("aso"),
    )


def _ranged(histogram: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """The histogram with each value's range, the sample's size and how many rows lie in the ranges before."""
    buckets = -(-histogram.count() // RANGE_VALUES)
    bucketed = by_value(histogram, "_v", value_buckets(histogram, "_v", buckets))
    of_sample = Window.partitionBy(*keys)
    earlier = of_sample.orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    ranges = bucketed.groupBy(*keys, SEGMENT).agg(F.sum("_c").alias("_in")).select(
        *keys, SEGMENT, F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_in").over(of_sample).alias("_n"), F.xxhash64(F.lit(seed), *keys).alias("_seed"),
    )
    return null_safe_join(bucketed, ranges, [*keys, SEGMENT])


def _quantiles(ranged: DataFrame, by: list[str], dt: float, replicates: int) -> DataFrame:
    """(by, side, size, places, values): what one range holds of the drawn quantiles. A place is
    replicate × grid points + point; replicate 0 is the sample itself."""
    keys = [*by, "_side"]

    def look_up(table: pa.Table) -> pa.Table:
        value, count = (table.column(name).to_numpy() for name in ("_v", "_c"))
        order = np.argsort(value)
        n, start, seed = (table.column(name)[0].as_py() for name in ("_n", "_start", "_seed"))
        upto = start + np.cumsum(count[order])
        ranks = draw_ranks(n, dt, replicates, seed & 0xFFFFFFFFFFFFFFFF).ravel()
        places = np.flatnonzero((ranks > start) & (ranks <= upto[-1]))
        found = value[order][np.searchsorted(upto, ranks[places])]
        lists = [pa.array([places.astype(np.int32)], pa.list_(pa.int32())), pa.array([found], pa.list_(pa.float64()))]
        return pa.table([*(table.column(k).slice(0, 1) for k in [*keys, "_n"]), *lists], [*keys, "_n", "_places", "_values"])

    fields = [ranged.schema[k] for k in [*keys, "_n"]]
    more = StructType.fromDDL("_places array<int>, _values array<double>").fields
    return ranged.groupBy(*keys, SEGMENT).applyInArrow(look_up, StructType([*fields, *more]))


def _violations(looked_up: DataFrame, by: list[str], dt: float, replicates: int) -> DataFrame:
    """(by, n_first, n_second, violation, _spread) of analyses that have both samples."""
    points = len(_positions(1, dt))
    fields = [looked_up.schema[k] for k in by]
    numbers = StructType.fromDDL("n_first bigint, n_second bigint, violation double, _spread double")
    schema = StructType([*fields, *numbers.fields])

    def compare(table: pa.Table) -> pa.Table:
        sides = table.column("_side").to_pylist()
        if len(set(sides)) < 2:
            return pa.table([table.column(k).slice(0, 0) for k in by] + [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], schema.names)
        size: dict[str, int] = {}
        drawn = {side: np.empty((replicates + 1) * points) for side in "ab"}
        for side, n, places, values in zip(sides, *(table.column(c) for c in ("_n", "_places", "_values"))):
            size[side] = n.as_py()
            drawn[side][places.values.to_numpy()] = values.values.to_numpy()
        share = violation(*(drawn[side].reshape(-1, points) for side in "ab"))
        row = [size["a"], size["b"], share[0], share[1:].std() if replicates else 0.0]
        return pa.table([*(table.column(k).slice(0, 1) for k in by), *([x] for x in row)], schema.names)

    return looked_up.groupBy(*by).applyInArrow(compare, schema)
