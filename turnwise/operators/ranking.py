"""Exact samples, folds, ranks and top rows, cut into ranges so that no class is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.sampling import hash_bucket, hash_mod, hash_order
from turnwise.session import cut_lineage

#: ``monotonically_increasing_id`` has the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def take_lowest(df: DataFrame, by: Sequence[str], key: str, seed: int, quota: Column) -> DataFrame:
    """The rows of each class whose seeded hash is among the ``quota`` lowest.

    Counts per (class, hash range) say which ranges are in, out, or cut; only the cut range of a
    class, a four-thousandth of it, is ranked. ``quota`` is an expression over the class counts
    ``_class_size`` and ``_smallest``.
    """
    by, columns = list(by), df.columns
    hashed = df.withColumn("_order", hash_order(F.col(key), seed)).withColumn(
        "_bucket", hash_bucket(F.col("_order"))
    )
    # A few thousand rows per class, used three times: the source is counted once.
    sizes = cut_lineage(hashed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n")))
    per_class = Window.partitionBy(*by)
    before = per_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    classes = sizes.groupBy(*by).agg(F.sum("_n").alias("_class_size"))
    smallest = classes.agg(F.min("_class_size")).first()[0] or 0
    plan = (
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_class_size", F.sum("_n").over(per_class))
        .withColumn("_smallest", F.lit(smallest))
        .withColumn("_left", quota - F.col("_before"))
        .filter("_left > 0")
        .select(*[F.col(b).alias(f"_by_{b}") for b in by], "_bucket", "_left", "_n")
    )
    plan = plan.withColumnRenamed("_bucket", "_plan_bucket")
    joined = hashed.join(plan, (F.col("_bucket") == F.col("_plan_bucket")) & _same(by))
    whole = joined.filter(F.col("_n") <= F.col("_left"))
    cut = joined.filter(F.col("_n") > F.col("_left")).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_order", key))
    )
    return whole.select(*columns).unionByName(
        cut.filter(F.col("_rank") <= F.col("_left")).select(*columns)
    )


def _same(by: Sequence[str]) -> Column:
    condition = F.lit(True)
    for b in by:
        condition = condition & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return condition


def balance(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """Every class cut down to the size of the smallest."""
    return take_lowest(df.filter(F.col(label).isNotNull()), [label], key, seed, F.col("_smallest"))


def sample_n(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` random rows per stratum, or all of a smaller one."""
    return take_lowest(df, by, key, seed, F.lit(n))


def assign_fold(df: DataFrame, key: str, k: int, seed: int = 0, shuffle: bool = True, into: str = "fold") -> DataFrame:
    """Fold number 0..k-1: by hash of the key, or contiguous blocks of the key's order, of any type, in which
    the first ``n mod k`` folds have one row more. Nulls come first; equal keys are in any order."""
    if shuffle:
        return df.withColumn(into, hash_mod(F.col(key), seed, k))
    size, longer = F.floor(F.col("_total") / k), F.col("_total") % k
    position, edge = F.col("_position"), longer * (size + 1)
    fold = F.when(position < edge, F.floor(position / (size + 1))).otherwise(
        longer + F.floor((position - edge) / F.greatest(size, F.lit(1)))
    )
    return _placed(df, [key]).select(*df.columns, fold.cast("int").alias(into))


def _placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``_position`` (from 0) in an order of columns of any type, and ``_total``.

    Spark draws the ranges from a sample of the keys. A row's position is its place in its sorted range
    after all rows of the ranges before.
    """
    ranges = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    place = F.monotonically_increasing_id()
    rows = ranges.withColumns(
        {"_range": F.shiftright(place, _PLACE_BITS), "_place": place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))}
    )
    every = Window.orderBy("_range")
    starts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range",
        (F.sum("_n").over(every) - F.col("_n")).alias("_before"),
        F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    # One row a range, so it is as small as the number of partitions.
    placed = rows.join(F.broadcast(starts), "_range")
    return placed.withColumn("_position", F.col("_before") + F.col("_place"))


def global_rank(df: DataFrame, column: str, ties: Sequence[str] = (), into: str = "_position") -> DataFrame:
    """Position (from 0) in the order of a column of any type, without sorting in one task."""
    return _placed(df, [column, *ties]).select(*df.columns, F.col("_position").alias(into))


def hold_out(key: str, repeat: int | Column, share: float = 0.25, seed: int = 0) -> Column:
    """Whether the row belongs to the test part of a repeat."""
    draw = hash_mod(F.concat_ws("/", F.col(key).cast("string"), _text(repeat)), seed, 1_000_000)
    return draw < int(share * 1_000_000)


def _text(value: int | Column) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def rank_by_magnitude(df: DataFrame, by: Sequence[str], value: str, name: str, into: str = "rank") -> DataFrame:
    """Rank of each coefficient of a fit by absolute value; ties by name. A fit has few."""
    order = Window.partitionBy(*by).orderBy(F.abs(F.col(value)).desc(), F.col(name))
    return df.withColumn(into, F.row_number().over(order))


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(
    df: DataFrame, by: Sequence[str], n: int, order: Sequence[Column], salt: Column, salts: int = 32,
    into: str = "rank",
) -> DataFrame:
    """The first ``n`` rows of each group: first within salted parts of a group, then among those."""
    parts = Window.partitionBy(*by, "_salt").orderBy(*order)
    best = (
        df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
        .withColumn(into, F.row_number().over(parts))
        .filter(F.col(into) <= n)
        .drop("_salt")
    )
    return best.withColumn(
        into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    ).filter(F.col(into) <= n)
