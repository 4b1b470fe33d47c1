"""Linear probes: can a label be read off the representations of a layer?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.config import ASO_THRESHOLD, PROBE_MARKERS
from turnwise.operators.aggregates import null_safe_join
from turnwise.operators.classification import (
    confusion_counts,
    majority_baseline,
    random_baseline,
    summary_scores,
)
from turnwise.operators.dominance import aso
from turnwise.operators.filters import binarize, known
from turnwise.operators.logistic import fit_cells, predict_cells
from turnwise.operators.ranking import balance, hold_out
from turnwise.session import cut_lineage

REPEATS = 5
TEST_SHARE = 0.25


def probe_dataset(
    df: DataFrame, label: str, key: str, balanced: bool, seed: int = 0, rules=None,
    markers: Sequence[str] = PROBE_MARKERS,
) -> DataFrame:
    """Rows to probe: a balanced 0/1 contrast, or all known values."""
    if balanced:
        return balance(binarize(df, label, rules), label, key, seed)
    return known(df, label, markers)


def representations_of(representations: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return representations.join(rows.select(key), key, "left_semi")


def probe_predictions(
    df: DataFrame, label: str, features: str, layer: str, key: str, repeats: int = REPEATS,
    share: float = TEST_SHARE, seed: int = 0,
) -> DataFrame:
    """(layer, cv, key, true, predicted) on the held-out rows of every repeat.

    All layers and repeats are fitted together, with the penalty ½|w|². Rows without a label or a
    representation are left out. A repeat of a layer without training rows has no predictions. Classes are
    few: their names are collected.
    """
    rows = df.select(
        F.col(layer).alias("_layer"), F.col(key).alias("_key"), F.col(label).cast("string").alias("_true"),
        F.col(features).cast("array<double>").alias("features"),
        F.array(*[hold_out(key, cv, share, seed) for cv in range(repeats)]).alias("held"),
    ).filter(F.col("_true").isNotNull() & F.col("features").isNotNull())
    # In order of layer, so that a task has the sums of one layer's fits at a time.
    rows = cut_lineage(rows.repartitionByRange("_layer", F.xxhash64("_key")).sortWithinPartitions("_layer"))
    names = rows.agg(F.array_sort(F.collect_set("_true"))).first()[0]
    number = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("_true")) - 1
    rows = rows.withColumn("y", number.cast("int"))
    fits = fit_cells(rows.drop("_key", "_true"), len(names))
    predicted = predict_cells(rows, fits, ["_key", "_true"])
    listed = F.array(*map(F.lit, names)).cast("array<string>")
    return predicted.select(
        F.col("_layer").alias(layer), F.col("repeat").alias("cv"), F.col("_key").alias(key), F.col("_true").alias("true"),
        F.get(listed, "predicted").alias("predicted"),
    )


def probe_scores(predictions: DataFrame, layer: str, key: str, seed: int = 0) -> DataFrame:
    """Macro F1 of the probe and of both baselines per (layer, cv)."""
    by = [layer, "cv"]
    predictions = cut_lineage(predictions)
    based = random_baseline(
        majority_baseline(predictions, by, "true"), by, "true", key, seed
    )
    scored = {
        "f1": "predicted",
        "majority_f1": "majority",
        "random_f1": "random",
    }
    long = based.unpivot([*by, "true"], list(scored.values()), "_source", "_predicted")
    counts = confusion_counts(long, [*by, "_source"], "true", "_predicted")
    macro = summary_scores(counts, [*by, "_source"])
    return macro.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_source") == source, F.col("macro_f1"))).alias(name)
            for name, source in scored.items()
        ]
    )


def with_dominance(scores: DataFrame, by: Sequence[str], seed: int = 42, threshold: float = ASO_THRESHOLD) -> DataFrame:
    """Both ASO scores of the probe over its baselines, and whether it is better, per analysis."""
    result = scores = cut_lineage(scores)
    for name in ("majority", "random"):
        scored = aso(scores, by, "f1", f"{name}_f1", seed).select(
            *by, F.col("aso").alias(f"{name}_aso"), (F.col("aso") < threshold).alias(f"{name}_better")
        )
        result = null_safe_join(result, scored, list(by))
    return result


def better_layers(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Layers in which the probe beats both baselines in every fold."""
    return scores.groupBy(*by).agg(
        (F.bool_and("majority_better") & F.bool_and("random_better")).alias("better"),
        F.avg("f1").alias("mean_f1"),
    )
