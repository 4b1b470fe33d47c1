"""Group summaries. All of them are built-in aggregates, so Spark combines them before shuffling."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.numeric import clean, ratio


def conversation_means(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean of every feature per key; rows with a null key part are left out, NaN is skipped."""
    return (
        df.na.drop(subset=list(keys))
        .groupBy(*keys)
        .agg(*[F.avg(clean(F.col(f).cast("double"))).alias(f) for f in features])
    )


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, second central moment and both variances; NaN is skipped like null."""
    v = clean(F.col(value).cast("double"))
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"),
        F.var_pop(v).alias("var_pop"),
        F.var_samp(v).alias("var_samp"),
    )


def group_means(df: DataFrame, by: Sequence[str], group: str, outcome: str) -> DataFrame:
    """Count, mean and variance of each group; NaN is skipped like null."""
    v = clean(F.col(outcome).cast("double"))
    return df.groupBy(*by, group).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var")
    )


def group_spread(df: DataFrame, by: Sequence[str], group: str, outcome: str) -> DataFrame:
    """Largest minus smallest group mean."""
    means = group_means(df, by, group, outcome)
    return means.groupBy(*by).agg(
        F.max("mean").alias("max_mean"),
        F.min("mean").alias("min_mean"),
        (F.max("mean") - F.min("mean")).alias("diff_mean"),
    )


def mean_ci(df: DataFrame, keys: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """Mean with its normal interval; NaN is skipped like null."""
    v = clean(F.col(value).cast("double"))
    half = F.lit(z) * F.stddev_samp(v) / F.sqrt(F.count(v))
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.avg(v) - half).alias("low"),
        (F.avg(v) + half).alias("high"),
    )


def mean_ci_bootstrap(
    df: DataFrame, keys: Sequence[str], value: str, replicates: int = 1000, level: float = 0.95, seed: int = 0
) -> DataFrame:
    """Mean with a bootstrap percentile interval.

    Each replicate weights a row by a Poisson(1) draw, so equal values of a group are weighted
    together by one Poisson(count) draw. Tasks add up weights for the groups they see; only
    (group, replicate) sums are shuffled. Draws are seeded by group and value.
    """
    keys = list(keys)
    histogram = (
        df.filter(clean(F.col(value).cast("double")).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
        .withColumn("_seed", F.xxhash64(F.lit(seed), *keys, "_value"))
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(keys, dropna=False, sort=False):
                weights = np.zeros(replicates)
                sums = np.zeros(replicates)
                for v, n, s in zip(part["_value"], part["_count"], part["_seed"]):
                    drawn = np.random.default_rng(s & 0xFFFFFFFFFFFFFFFF).poisson(n, replicates)
                    weights += drawn
                    sums += drawn * v
                out = pd.DataFrame({"_replicate": np.arange(replicates), "_w": weights, "_s": sums})
                for k in keys:
                    out[k] = part[k].iloc[np.zeros(replicates, dtype=int)].to_numpy()
                yield out[[*keys, "_replicate", "_w", "_s"]]

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    drawn = histogram.mapInPandas(draw, f"{fields}, _replicate INT, _w DOUBLE, _s DOUBLE")
    tail = (1 - level) / 2
    replicated = (
        drawn.groupBy(*keys, "_replicate")
        .agg(F.try_divide(F.sum("_s"), F.sum("_w")).alias("_mean"))
        .groupBy(*keys)
        .agg(
            F.percentile("_mean", F.lit(tail)).alias("low"),
            F.percentile("_mean", F.lit(1 - tail)).alias("high"),
        )
    )
    means = histogram.groupBy(*keys).agg(
        F.sum("_count").alias("n"),
        ratio(F.sum(F.col("_value") * F.col("_count")), F.sum("_count")).alias("mean"),
    )
    return null_safe_join(means, replicated, keys)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join that matches null keys with null keys; the keys of a left or inner join are the left ones."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def class_summary(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Smallest class size, number of classes, and the majority class (ties: the smaller value)."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(*keys, label).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return sizes.groupBy(*keys).agg(
        F.min("_n").alias("min_size"),
        F.count(F.lit(1)).alias("n_classes"),
        F.min(F.struct(-F.col("_n"), F.col(label)))[label].alias("majority"),
        F.max("_n").alias("majority_size"),
        F.sum("_n").alias("n"),
    )


def outcome_per_conversation(answers: DataFrame, keys: Sequence[str], score: str, percent: Column) -> DataFrame:
    """Mean score over a conversation's answers, ×100 where ``percent``; null scores are skipped
    and a conversation without any score is dropped."""
    return (
        answers.groupBy(*keys)
        .agg(F.avg(score).alias("_mean"))
        .filter(F.col("_mean").isNotNull())
        .select(*keys, (F.col("_mean") * F.when(percent, 100.0).otherwise(1.0)).alias("outcome"))
    )


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """Several groupings of one table in one pass; ``grouping`` tells them apart."""
    keys = list(dict.fromkeys(itertools.chain.from_iterable(sets)))
    named = [[F.col(k) for k in s] for s in sets]
    grouped = df.groupingSets(named, *[F.col(k) for k in keys])
    return grouped.agg(F.grouping_id(*keys).alias("grouping"), *aggregates)
