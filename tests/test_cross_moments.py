"""The sparse cross moments against the dense one-hot matrix, in one scan and for any number of levels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import cross_moments as own
from turnwise.operators.cross_moments import cross_moments, dense_moments, feature_names, with_intercept
from turnwise.operators.gram import contiguous_matrix, gram, merge
from turnwise.operators.ranking import assign_fold
from turnwise.operators.regression import ols, ols_from_gram, standardise
from turnwise.operators.reshape import dummies

ROWS = "id INT, k STRING, a DOUBLE, b DOUBLE, topic STRING, age STRING, y DOUBLE"


def drawn(n=400, seed=2, shift=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = rng.normal(size=2)
        topic, age = f"t{rng.integers(5)}", f"g{rng.integers(3)}"
        y = 2 * a - b + len(topic) + int(topic[1]) * 0.5 - int(age[1]) + rng.normal() + shift
        rows.append((
            i, "pq"[i % 2] if i % 50 else None, float(a + shift), float(b) if i % 37 else None,
            topic if i % 11 else None, age, float(y) if i % 41 else float("nan"),
        ))
    return rows


def matrices(df, keys):
    return {tuple(r[k] for k in keys): contiguous_matrix(r["moments"]) for r in df.collect()}


@pytest.mark.parametrize("held", [1 << 22, 10])
def test_dense_matrix_equals_that_of_the_one_hot_columns(spark, monkeypatch, held):
    monkeypatch.setattr(own, "HELD_SUMS", held)
    df = spark.createDataFrame(drawn(), ROWS).repartition(5)
    cross = cross_moments(df, ["a", "b"], ["topic", "age"], "y", ["k"])
    xs = feature_names(cross)
    coded = dummies(df, ["topic", "age"])
    assert xs == ["a", "b", *[f"dummy_topic_t{i}" for i in range(5)], *[f"dummy_age_g{i}" for i in range(3)]]
    shifted = coded.withColumn("y", F.col("y") - float(cross.middle[-1]))
    got = matrices(dense_moments(cross, xs, scale=False), ["k"])
    expected = matrices(gram(shifted, xs, "y", ["k"]), ["k"])
    assert set(got) == set(expected) == {("p",), ("q",), (None,)}
    for key in got:
        np.testing.assert_allclose(got[key], expected[key], atol=1e-9)
    some = ["b", "dummy_age_g1"]
    got = matrices(dense_moments(cross, some, scale=False), ["k"])
    at = [0, *[1 + xs.index(x) for x in some], len(xs) + 1]
    for key in got:
        np.testing.assert_allclose(got[key], expected[key][np.ix_(at, at)], atol=1e-9)


def test_scaling_is_over_all_folds(spark):
    df = assign_fold(spark.createDataFrame(drawn(), ROWS).na.drop(subset=["b"]).filter("NOT isnan(y)"), "id", 4, 1)
    cross = cross_moments(df, ["a", "b"], ["topic", "age"], "y", ["fold"])
    xs = feature_names(cross)
    scaled = dummies(standardise(df, ["a", "b"]), ["topic", "age"]).withColumn("y", F.col("y") - float(cross.middle[-1]))
    got, expected = (matrices(m, ["fold"]) for m in (dense_moments(cross, xs), gram(scaled, xs, "y", ["fold"])))
    for key in expected:
        np.testing.assert_allclose(got[key], expected[key], atol=1e-8)
    fits = with_intercept(ols_from_gram(merge(dense_moments(cross, xs), []), xs), cross)
    direct = ols(dummies(standardise(df, ["a", "b"]), ["topic", "age"]), "y", xs)
    for left, right in zip(fits.orderBy("feature").collect(), direct.orderBy("feature").collect()):
        assert left.feature == right.feature and left.n == right.n
        np.testing.assert_allclose([left.coefficient, left.intercept, left.r2], [right.coefficient, right.intercept, right.r2], atol=1e-7)


def test_large_means_keep_their_digits(spark):
    near, far = (
        with_intercept(ols_from_gram(dense_moments(c, xs := feature_names(c)), xs), c).orderBy("feature").collect()
        for c in (cross_moments(spark.createDataFrame(drawn(shift=s), ROWS), ["a", "b"], ["age"], "y") for s in (0.0, float(2**30)))
    )
    for one, two in zip(near, far):
        assert abs(one.coefficient - two.coefficient) < 1e-6 and abs(one.r2 - two.r2) < 1e-7
        assert abs(two.intercept - one.intercept - 2**30) < 1e-5


def test_more_levels_than_columns_could_name(spark):
    levels = 2300
    df = spark.range(4 * levels).select(
        "id", F.concat(F.lit("t"), F.col("id") % levels).alias("topic"), ((F.col("id") * 7919) % 101).cast("double").alias("x"),
    ).withColumn("y", F.col("x") * 3 + F.col("id") % levels)
    cross = cross_moments(df, ["x"], ["topic"], "y")
    xs = feature_names(cross)
    assert len(xs) == levels + 1
    fit = {r.feature: r for r in ols_from_gram(dense_moments(cross, xs, scale=False), xs).collect()}
    assert abs(fit["x"].coefficient - 3) < 1e-6 and fit["x"].r2 > 1 - 1e-9
    assert abs(fit["dummy_topic_t2299"].coefficient - fit["dummy_topic_t0"].coefficient - 2299) < 1e-4


def test_the_rows_are_scanned_once(spark, tmp_path):
    spark.createDataFrame(drawn(), ROWS).write.parquet(f"{tmp_path}/rows")
    cross = cross_moments(spark.read.parquet(f"{tmp_path}/rows"), ["a", "b"], ["topic", "age"], "y", ["k"])
    xs = feature_names(cross)
    plan = dense_moments(cross, xs)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Scan ExistingRDD" in plan


def test_no_rows(spark):
    cross = cross_moments(spark.createDataFrame([], ROWS), ["a"], ["topic"], "y")
    assert feature_names(cross) == ["a"] and dense_moments(cross, ["a"]).count() == 0
