"""Which features explain an outcome: design matrix, regressions, importances."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from turnwise.config import COLLINEAR_FEATURES, CV_FOLDS
from turnwise.operators.cross_moments import cross_moments, dense_moments, feature_names, with_intercept
from turnwise.operators.filters import min_group_size
from turnwise.operators.gram import complete_rows, merge
from turnwise.operators.importance import family_importance, importance_change
from turnwise.operators.ranking import assign_fold
from turnwise.operators.regression import (
    best_penalty,
    elastic_net_fit,
    elastic_net_grid,
    ols_from_gram,
    standardise,
)
from turnwise.operators.reshape import dummy_name
from turnwise.session import cut_lineage


def least_squares_rows(
    df: DataFrame, outcome: str, features: Sequence[str], demographics: Sequence[str], topic: str,
    drop_collinear: Sequence[str] = COLLINEAR_FEATURES,
) -> tuple[DataFrame, list[str]]:
    """Complete rows, then the features that are not collinear, scaled, of topics of at least two conversations."""
    used = [f for f in features if f not in set(drop_collinear)]
    rows = df.select(*demographics, topic, *features, outcome).na.drop()
    return min_group_size(standardise(rows, used), [topic]), used


def elastic_net_rows(
    df: DataFrame, outcome: str, features: Sequence[str], demographics: Sequence[str], topic: str, key: str,
    folds: int = CV_FOLDS, seed: int = 42,
) -> DataFrame:
    """All features scaled over all rows, of topics of at least two conversations, with a fold. Only then are
    rows without an outcome or a feature left out; one without a group has none of its levels."""
    rows = df.select(key, *demographics, topic, *features, outcome)
    scaled = complete_rows(min_group_size(standardise(rows, features), [topic]), features, outcome)
    return assign_fold(scaled, key, folds, seed)


@dataclass
class Explanation:
    ols: DataFrame
    elastic_net: DataFrame
    without_topic: DataFrame
    families: DataFrame
    change: DataFrame


def explain_outcome(
    df: DataFrame, outcome: str, features: Sequence[str], demographics: Sequence[str], topic: str,
    key: str, folds: int = CV_FOLDS, seed: int = 42,
) -> Explanation:
    """Least squares, the cross-validated elastic net, and its refit without topics.

    Least squares leaves the collinear features out; the elastic net has all of them, as its penalty picks among
    them. Each of the two reads its rows once. Groups and topics are levels of their cross moments, so there may
    be any number.
    """
    groups = [*demographics, topic]
    rows, used = least_squares_rows(df, outcome, features, demographics, topic)
    plain = cross_moments(rows, used, groups, outcome)
    names = feature_names(plain)
    least_squares = with_intercept(ols_from_gram(dense_moments(plain, names, scale=False), names), plain)
    cross = cross_moments(
        elastic_net_rows(df, outcome, features, demographics, topic, key, folds, seed), features, groups, outcome, ["fold"]
    )
    xs = feature_names(cross)
    moments = cut_lineage(dense_moments(cross, xs, scale=False))
    total = merge(moments, [])
    penalty = cut_lineage(best_penalty(elastic_net_grid(moments, "fold")))
    topics = [x for x in xs if x.startswith((dummy_name("topic", ""), dummy_name(topic, "")))]
    full = with_intercept(elastic_net_fit(total, penalty, xs), cross)
    reduced = with_intercept(elastic_net_fit(total, penalty, xs, without=topics), cross)
    return Explanation(
        least_squares,
        full,
        reduced,
        family_importance(full, [], demographics),
        importance_change(full, reduced, [], demographics),
    )
