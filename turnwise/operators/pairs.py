"""Differences between all pairs of conversations, without forming a pair.

Within a block of n values, over all ordered pairs including self-pairs: the pair count is n²,
Σ(x−y)² is 2(nΣx² − (Σx)²), and Σ|x−y| is 2Σ v·c·(before − after) over counted values v in order, c
their counts, before and after the members on both sides. Entries of one value may stand in any
order, as their terms sum to the same. The four same/different combinations of group and topic are
sums and differences of those totals over four ways to form blocks.

The input is counted once by group, topic and value. The counts are dealt out in ranges of the value, and
one pass over a range keeps the sums of all four kinds of blocks; a block's sums in a range then meet the
number of its members in earlier ranges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from turnwise.config import UNKNOWN_MARKERS
from turnwise.functions.numeric import clean, ratio
from turnwise.operators.filters import known, without_outliers
from turnwise.operators.ordered import SEGMENT, key_runs
from turnwise.operators.reshape import unpivot_demographics
from turnwise.session import cut_lineage

# Each block kind keeps group and topic, only one of them, or neither.
_BLOCKS = {"group_topic": (True, True), "group": (True, False), "topic": (False, True), "all": (False, False)}

# Which multiple of each block total makes a cell of the 2×2 table.
_CELLS = {
    "same_group_same_topic": {"group_topic": 1},
    "diff_group_same_topic": {"topic": 1, "group_topic": -1},
    "same_group_diff_topic": {"group": 1, "group_topic": -1},
    "diff_group_diff_topic": {"all": 1, "group": -1, "topic": -1, "group_topic": 1},
}


_SUMS = ("_n", "_s1", "_s2", "_lean")


def _sums_in_ranges(finest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per block and range of values the sums of c, v·c, v²·c and v·c·(2·before + c), where ``before``
    counts the range alone. Values are taken from their mean, so that squares keep their digits."""
    mean = finest.agg(F.try_divide(F.sum(F.col("_v") * F.col("_c")), F.sum("_c"))).first()[0] or 0.0
    order = [*keys, "_v", "group", "_t"]
    ranges = finest.select(*order, "_c").repartitionByRange(*order).sortWithinPartitions(*order)
    key_fields = [finest.schema[k] for k in keys]
    texts = [StructField(name, StringType()) for name in ("kind", "block_group", "block_topic")]
    sums = [StructField(name, DoubleType()) for name in _SUMS]
    schema = StructType([*key_fields, StructField(SEGMENT, IntegerType()), *texts, *sums])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, key, blocks = TaskContext.get().partitionId(), None, {}

        def rows(types: list[pa.DataType]) -> pa.RecordBatch:
            n = len(blocks)
            names = [pa.array(list(column), pa.string()) for column in zip(*blocks)]
            totals = [pa.array(column) for column in np.array(list(blocks.values())).T]
            of_key = [pa.array([value] * n, kind) for value, kind in zip(key, types)]
            return pa.RecordBatch.from_arrays([*of_key, pa.array([here] * n, pa.int32()), *names, *totals], schema.names)

        types: list[pa.DataType] = []
        for batch in batches:
            types = batch.schema.types
            for run_key, start, end in key_runs(batch.columns[: len(keys)]):
                if blocks and run_key != key:
                    yield rows(types)
                    blocks = {}
                key = run_key
                v, group, topic, c = batch.slice(start, end - start).columns[len(keys) :]
                _add_run(blocks, group, topic, v.to_numpy() - mean, c.to_numpy())
        if blocks:
            yield rows(types)

    return ranges.mapInArrow(add_up, schema)


def _add_run(blocks: dict[tuple, np.ndarray], group: pa.Array, topic: pa.Array, v: np.ndarray, c: np.ndarray) -> None:
    """Add counted values in order to the sums of their blocks."""
    group, topic = group.dictionary_encode(), topic.dictionary_encode()
    groups, topics = group.dictionary.to_pylist(), topic.dictionary.to_pylist()
    group, topic = group.indices.to_numpy().astype(np.int64), topic.indices.to_numpy().astype(np.int64)
    for kind, (keep_group, keep_topic) in _BLOCKS.items():
        codes, of = np.unique(group * keep_group * len(topics) + topic * keep_topic, return_inverse=True)
        names = [
            (kind, groups[code // len(topics)] if keep_group else "", topics[code % len(topics)] if keep_topic else "")
            for code in codes.tolist()
        ]
        so_far = np.array([blocks[name][0] if name in blocks else 0.0 for name in names])
        together = np.argsort(of, kind="stable")
        running = np.cumsum(c[together]) - c[together]
        first = np.searchsorted(of[together], np.arange(len(codes)))
        before = np.empty(len(c))
        before[together] = running - running[first][of[together]]
        before += so_far[of]
        added = np.stack([
            np.bincount(of, x, len(codes)) for x in (c, v * c, v * v * c, v * c * (2 * before + c))
        ], axis=1)
        for name, sums in zip(names, added):
            blocks[name] = blocks[name] + sums if name in blocks else sums


def pair_table(
    df: DataFrame, demographics: Sequence[str], topic: str, outcome: str, by: Sequence[str] = (),
    markers: Sequence[str] = UNKNOWN_MARKERS, unordered: bool = False,
) -> DataFrame:
    """Count, mean and variance of |difference| per cell, pooled over demographics.

    ``unordered`` counts each pair once and leaves out self-pairs; the default follows the
    original definition.
    """
    by = list(by)
    rows = without_outliers(df, topic).filter(F.col(topic).isNotNull())
    rows = rows.select(
        *by,
        *demographics,
        F.col(topic).cast("string").alias("_t"),
        clean(F.col(outcome).cast("double")).alias("_v"),
    ).filter(F.col("_v").isNotNull())
    finest = cut_lineage(
        known(unpivot_demographics(rows, [*by, "_t", "_v"], demographics), "group", markers)
        .groupBy(*by, "demo", "group", "_t", "_v")
        .agg(F.count(F.lit(1)).cast("double").alias("_c"))
    )
    keys = [*by, "demo", "kind", "block_group", "block_topic"]
    parts = _sums_in_ranges(finest, [*by, "demo"])
    earlier = Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0.0))
    totals = (
        parts.withColumn("_lean", F.col("_lean") + 2 * before * F.col("_s1"))
        .groupBy(*keys)
        .agg(*[F.sum(m).alias(m) for m in _SUMS])
    )
    n = F.col("_n")
    exact = n.cast("decimal(18,0)")  # squares of counts pass the range of a long, and of exact doubles
    summed = totals.groupBy(*by, "kind").agg(
        F.sum(exact * exact).cast("decimal(38,0)").alias("pairs"),
        F.sum(exact).cast("decimal(38,0)").alias("selves"),
        F.sum(2 * (F.col("_lean") - n * F.col("_s1"))).alias("abs_sum"),
        F.sum(2 * (n * F.col("_s2") - F.pow("_s1", 2))).alias("sq_sum"),
    )
    cells = F.array(
        *[
            F.struct(F.lit(cell).alias("cell"), F.lit(float(weights.get(kind, 0))).alias("weight"),
                     F.lit(kind).alias("of"))
            for cell, weights in _CELLS.items()
            for kind in _BLOCKS
            if kind in weights
        ]
    )
    combined = (
        summed.select("*", F.inline(cells))
        .filter(F.col("kind") == F.col("of"))
        .groupBy(*by, "cell")
        .agg(
            *[
                F.sum(F.col(m) * F.col("weight").cast("decimal(2,0)")).cast("decimal(38,0)").alias(m)
                for m in ("pairs", "selves")
            ],
            *[F.sum(F.col(m) * F.col("weight")).alias(m) for m in ("abs_sum", "sq_sum")],
        )
    )
    if unordered:
        combined = combined.withColumns(
            {
                "pairs": (
                    (F.col("pairs") - F.when(F.col("cell") == "same_group_same_topic", F.col("selves")).otherwise(F.lit(0))) / 2
                ).cast("decimal(38,0)"),
                "abs_sum": F.col("abs_sum") / 2,
                "sq_sum": F.col("sq_sum") / 2,
            }
        )
    count = F.col("pairs").cast("double")
    spread = F.col("sq_sum") - ratio(F.pow("abs_sum", 2), count)
    return combined.select(
        *by,
        "cell",
        F.col("pairs").alias("n"),
        ratio(F.col("abs_sum"), count).alias("mean"),
        ratio(spread, count - 1).alias("var"),
        F.sqrt(F.greatest(ratio(spread, count - 1), F.lit(0.0))).alias("sd"),
    )
