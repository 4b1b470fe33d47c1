"""Confusion counts, classification scores and baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.numeric import ratio
from turnwise.functions.sampling import hash_mod
from turnwise.operators.aggregates import class_summary, null_safe_join
from turnwise.session import stored


def confusion_counts(
    df: DataFrame, by: Sequence[str], true: str, predicted: str, weight: str | None = None
) -> DataFrame:
    """Counts of the label pairs that occur; rows without a prediction are left out. ``weight``: how many
    rows a row stands for."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        df.filter(F.col(true).isNotNull() & F.col(predicted).isNotNull())
        .groupBy(*by, F.col(true).alias("true"), F.col(predicted).alias("predicted"))
        .agg(n.alias("n"))
    )


def confusion_matrix(df: DataFrame, by: Sequence[str], true: str, predicted: str) -> DataFrame:
    """The full label grid with counts and row shares. The labels of an analysis are few and are
    expanded from one array of them."""
    by = list(by)
    cells = confusion_counts(df, by, true, predicted)
    grid = (
        cells.select(*by, F.explode(F.array("true", "predicted")).alias("label"))
        .groupBy(*by)
        .agg(F.collect_set("label").alias("_labels"))
        .select(*by, "_labels", F.explode("_labels").alias("true"))
        .select(*by, "true", F.explode("_labels").alias("predicted"))
    )
    filled = null_safe_join(grid, cells, [*by, "true", "predicted"], "left").na.fill(0, ["n"])
    row = Window.partitionBy(*by, "true")
    return filled.withColumn("share", ratio(F.col("n"), F.sum("n").over(row)))


def class_scores(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts; 0 where undefined."""
    n = F.col("n")
    sides = F.array(
        F.struct(
            F.col("true").alias("label"),
            F.when(F.col("true") == F.col("predicted"), n).otherwise(0).alias("hits"),
            n.alias("actual"),
            F.lit(0).cast("bigint").alias("claimed"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(0).cast("bigint").alias("hits"),
            F.lit(0).cast("bigint").alias("actual"),
            n.alias("claimed"),
        ),
    )
    totals = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(
            F.sum("hits").alias("hits"),
            F.sum("actual").alias("support"),
            F.sum("claimed").alias("claimed"),
        )
    )
    zero = F.lit(0.0)
    return totals.select(
        *by,
        "label",
        F.coalesce(ratio(F.col("hits"), F.col("claimed")), zero).alias("precision"),
        F.coalesce(ratio(F.col("hits"), F.col("support")), zero).alias("recall"),
        F.coalesce(ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")), zero).alias("f1"),
        "support",
        "hits",
    )


def summary_scores(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy (which is micro F1), macro and weighted averages."""
    weight = F.col("support")
    return (
        class_scores(counts, by)
        .groupBy(*by)
        .agg(
            ratio(F.sum("hits"), F.sum(weight)).alias("micro_f1"),
            F.avg("precision").alias("macro_precision"),
            F.avg("recall").alias("macro_recall"),
            F.avg("f1").alias("macro_f1"),
            ratio(F.sum(F.col("precision") * weight), F.sum(weight)).alias("weighted_precision"),
            ratio(F.sum(F.col("recall") * weight), F.sum(weight)).alias("weighted_recall"),
            ratio(F.sum(F.col("f1") * weight), F.sum(weight)).alias("weighted_f1"),
            F.sum(weight).alias("support"),
        )
    )


def majority_baseline(df: DataFrame, by: Sequence[str], label: str, into: str = "majority") -> DataFrame:
    """Every row predicted as the most frequent label. The labels found are written first, a row a group, so
    that Spark knows their size before it would exchange the rows by group."""
    best = class_summary(df, by, label).select(*by, F.col("majority").alias(into))
    return null_safe_join(df, stored(best, "majority"), list(by))


def random_baseline(
    df: DataFrame, by: Sequence[str], label: str, key: str, seed: int = 0, into: str = "random"
) -> DataFrame:
    """Every row predicted as one of the observed labels, uniformly, by hash of its key. The labels are written
    first, as in ``majority_baseline``."""
    classes = (
        df.filter(F.col(label).isNotNull())
        .groupBy(*by)
        .agg(F.array_sort(F.collect_set(label)).alias("_classes"))
    )
    drawn = F.element_at("_classes", hash_mod(F.col(key), seed, F.size("_classes")) + 1)
    return null_safe_join(df, stored(classes, "classes"), list(by)).withColumn(into, drawn).drop("_classes")
