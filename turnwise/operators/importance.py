"""Feature families and their importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.numeric import percent_change
from turnwise.operators.aggregates import null_safe_join
from turnwise.operators.ranking import top_per_group

# The feature families, in table order.
FAMILIES = [
    "topic",
    "demographic",
    "emotion",
    "politeness",
    "sentiment",
    "concreteness",
    "reading_ease",
    "liwc",
    "linguistic",
]
SIDES = {"user": "user_prompt", "model": "model_response"}
NAME_LENGTH = 50


def short_name(feature: Column) -> Column:
    return F.left(F.substring_index(feature, "dummy_", -1), F.lit(NAME_LENGTH))


def families_of(feature: Column, demographics: Sequence[str]) -> Column:
    """Array of families; a name may belong to several, and to ``linguistic`` if to no other."""
    name = F.substring_index(feature, "dummy_", -1)
    demographic = F.lit(False)
    for d in demographics:
        demographic = demographic | F.contains(name, F.lit(d))
    tests = {
        "topic": F.startswith(name, F.lit("topic_")),
        "demographic": demographic,
        "emotion": F.startswith(name, F.lit("e_")),
        "politeness": F.contains(name, F.lit("politeness")),
        "sentiment": F.startswith(name, F.lit("s_")),
        "concreteness": F.contains(name, F.lit("concreteness")),
        "reading_ease": F.contains(name, F.lit("flesch_reading_ease")),
        "liwc": F.contains(name, F.lit("_liwc_")),
    }
    member = F.array_compact(F.array(*[F.when(test, F.lit(f)) for f, test in tests.items()]))
    return F.when(F.size(member) > 0, member).otherwise(F.array(F.lit("linguistic")))


def memberships(coefficients: DataFrame, demographics: Sequence[str]) -> DataFrame:
    """One row per selected feature and family."""
    return coefficients.filter(F.col("coefficient") != 0).withColumn(
        "family", F.explode(families_of(F.col("feature"), demographics))
    )


def family_importance(coefficients: DataFrame, by: Sequence[str], demographics: Sequence[str]) -> DataFrame:
    """Largest and mean absolute coefficient per family; 0 for a family without a feature."""
    size = F.abs(F.col("coefficient"))
    found = memberships(coefficients, demographics).groupBy(*by, "family").agg(
        F.max(size).alias("max_importance"), F.avg(size).alias("mean_importance")
    )
    every = coefficients.select(*by).distinct().withColumn(
        "family", F.explode(F.array(*[F.lit(f) for f in FAMILIES]))
    )
    joined = null_safe_join(every, found, [*by, "family"], "left")
    return joined.na.fill(0.0, ["max_importance", "mean_importance"])


def side_importance(coefficients: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same per side of the conversation."""
    size = F.abs(F.col("coefficient"))
    sides = F.array(
        *[F.when(F.contains("feature", F.lit(part)), F.lit(side)) for side, part in SIDES.items()]
    )
    return (
        coefficients.filter(F.col("coefficient") != 0)
        .withColumn("side", F.explode(F.array_compact(sides)))
        .groupBy(*by, "side")
        .agg(F.max(size).alias("max_importance"), F.avg(size).alias("mean_importance"))
    )


def top3_marks(importance: DataFrame, by: Sequence[str]) -> DataFrame:
    """The three leading families by largest and by (rounded) mean importance, with their rank."""
    long = importance.select(
        *by, "family", F.col("max_importance").alias("max"), F.round("mean_importance", 2).alias("mean")
    ).unpivot([*by, "family"], ["max", "mean"], "measure", "value")
    return top_per_group(
        long, [*by, "measure"], 3, [F.col("value").desc(), F.col("family")], F.col("family")
    )


def importance_change(
    full: DataFrame, reduced: DataFrame, by: Sequence[str], demographics: Sequence[str]
) -> DataFrame:
    """Median percent change of the demographic importances from the reduced fit to the full one;
    a feature the full fit does not select counts as 0 there."""
    of_reduced = memberships(reduced, demographics).filter(F.col("family") == "demographic")
    of_full = memberships(full, demographics).filter(F.col("family") == "demographic")
    joined = null_safe_join(
        of_reduced.select(*by, "feature", F.abs("coefficient").alias("_old")),
        of_full.select(*by, "feature", F.abs("coefficient").alias("_new")), [*by, "feature"], "left",
    )
    change = percent_change(F.coalesce(F.col("_new"), F.lit(0.0)), F.col("_old"))
    return joined.groupBy(*by).agg(
        F.median(change).alias("median_change"), F.count(F.lit(1)).alias("n_features")
    )
