"""Order-dependent values without gathering a whole key in one task.

Sums: rows of a key are cut into ordered segments. A window works inside a segment, a small table with
one row per (key, segment) carries the values over from the segments before, and an equi-join
brings them back. A key that holds a third of the table is then many segments, not one sort.

Scans: rows are sorted in ranges of (key, order), and each range hands one row on to the next. A row's
value then needs the rows before it in its range alone, and no table of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from turnwise.operators.aggregates import null_safe_join
from turnwise.session import cut_lineage

SEGMENT = "_segment"


def value_buckets(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Boundaries that split the column into ranges of about equal row counts."""
    if buckets is None:
        buckets = min(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1024)
    if buckets <= 1:
        return []
    probabilities = [i / buckets for i in range(1, buckets)]
    points = df.approxQuantile(column, probabilities, 0.25 / buckets)
    return sorted(set(points))


def by_value(df: DataFrame, column: str, boundaries: Sequence[float]) -> DataFrame:
    """Append the ordered range each value falls into."""
    if not boundaries:
        return df.withColumns({column: F.col(column).cast("double"), SEGMENT: F.lit(0)})
    splits = [float("-inf"), *boundaries, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=column, outputCol=SEGMENT).transform(
        df.withColumn(column, F.col(column).cast("double"))
    )
    # Whole numbers hash alike in joins and windows; doubles are normalised first, and the
    # exchanges of the two would differ.
    return bucketed.withColumn(SEGMENT, F.col(SEGMENT).cast("int"))


def sums_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], measures: Mapping[str, Column]
) -> DataFrame:
    """Per measure ``<name>_before``: its sum over the rows of the key that come earlier.

    ``df`` carries a segment column and the order is total within a key. Rows
    partitioned by key and segment are not shuffled again.
    """
    keys = list(keys)
    df = df.withColumns({name: value for name, value in measures.items()})
    offsets = _carried(
        df.groupBy(*keys, SEGMENT).agg(*[F.sum(m).alias(f"_all_{m}") for m in measures]),
        keys,
        {f"_offset_{m}": F.sum(f"_all_{m}") for m in measures},
    )
    inside = (
        Window.partitionBy(*keys, SEGMENT)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    df = df.withColumns({f"_inside_{m}": F.sum(m).over(inside) for m in measures})
    joined = null_safe_join(df, offsets, [*keys, SEGMENT])
    zero = F.lit(0)
    return joined.withColumns(
        {
            f"{m}_before": F.coalesce(F.col(f"_inside_{m}"), zero)
            + F.coalesce(F.col(f"_offset_{m}"), zero)
            for m in measures
        }
    ).drop(SEGMENT, *[f"_inside_{m}" for m in measures], *[f"_offset_{m}" for m in measures])


def _carried(summary: DataFrame, keys: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """Each value over the segments of the key that come before."""
    earlier = (
        Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    )
    return summary.select(
        *keys, SEGMENT, *[value.over(earlier).alias(name) for name, value in values.items()]
    )


@dataclass
class Carry:
    """What a scan has seen of the rows before: the last key, and a value that belongs to it."""

    key: tuple | None = None
    value: object = None


def in_ranges(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``df`` in ranges of (keys, order), each in order. A key with many rows is many ranges, however its
    order values are spread."""
    return cut_lineage(df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order))


def scan_in_order(
    ranges: DataFrame, keys: Sequence[str], value: Column, into: str,
    scan: Callable[[Carry, np.ndarray, tuple[pa.Array, ...], pa.Array], tuple[np.ndarray, object]],
    hand_on: Callable[[Carry, Carry, bool], object],
) -> DataFrame:
    """``ranges`` (of ``in_ranges``) with a boolean that ``scan`` computes from each row and those before it.

    ``scan`` gets the carry, where keys begin, the key arrays and the values of a batch, and returns the
    booleans and the value that belongs to the last key. A first pass reads the keys and the value alone and
    ends with one row a range; ``hand_on`` (carry into the range, carry at its end if none had come in, whether
    the range is one key) says what the next range starts from. The second pass adds the column.
    """
    rows = ranges.withColumn("_value", value)
    columns = [*keys, "_value"]
    fields = StructType([StructField("_range", IntegerType()), *rows.select(*columns).schema.fields, StructField("_one_key", BooleanType())])

    def last_of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, one_key, types = Carry(), True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            types = batch.schema.types
            *key, values = batch.columns
            starts = _key_starts(carry, key)
            one_key = one_key and not starts[1:].any() and (carry.key is None or not starts[0])
            carry = Carry(_key_at(key, -1), scan(carry, starts, tuple(key), values)[1])
        if carry.key is not None:
            here = TaskContext.get().partitionId()
            arrays = [pa.array([v], t) for v, t in zip((*carry.key, carry.value), types)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([here], pa.int32()), *arrays, pa.array([one_key], pa.bool_())], ["_range", *columns, "_one_key"]
            )

    ends = sorted(rows.select(*columns).mapInArrow(last_of_range, fields).collect(), key=lambda row: row[0])
    carries: dict[int, Carry] = {}
    carry = Carry()
    for row in ends:
        carries[row[0]] = carry
        own = Carry(tuple(row[1 : 1 + len(keys)]), row["_value"])
        carry = Carry(own.key, hand_on(carry, own, row["_one_key"]))

    def scanned(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        carry = carries.get(TaskContext.get().partitionId(), Carry())
        for *key, values in batches:
            if not len(values):
                yield pa.array([], pa.bool_())
                continue
            flags, last = scan(carry, _key_starts(carry, key), tuple(key), values)
            carry = Carry(_key_at(key, -1), last)
            yield pa.array(flags, pa.bool_())

    # It reads rows in their order, so Spark may neither move nor repeat it.
    flag = F.arrow_udf("boolean")(scanned).asNondeterministic()
    return rows.withColumn(into, flag(*columns)).drop("_value")


def same_as_before(array: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before; null equals null."""
    codes = array.dictionary_encode("encode").indices.to_numpy()
    return codes[1:] == codes[:-1]


def _key_at(key: Sequence[pa.Array], at: int) -> tuple:
    return tuple(array[at].as_py() for array in key)


def _key_starts(carry: Carry, key: Sequence[pa.Array]) -> np.ndarray:
    same = np.ones(len(key[0]), bool)
    same[0] = carry.key == _key_at(key, 0)
    for array in key:
        same[1:] &= same_as_before(array)
    return ~same


def key_runs(key: Sequence[pa.Array]) -> Iterator[tuple[tuple, int, int]]:
    """Each stretch of rows of a batch with one key: the key, its first row and the row after it."""
    if not len(key[0]):
        return
    starts = np.append(np.flatnonzero(_key_starts(Carry(), key)), len(key[0])).tolist()
    for start, end in zip(starts, starts[1:]):
        yield _key_at(key, start), start, end
