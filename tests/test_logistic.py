"""All probes in one job: coefficients as Spark ML's for one cell, other cells untouched by each other."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from turnwise.operators.logistic import cell_sums, fit_cells, newton_step, predict_cells
from turnwise.operators.probe import probe_predictions

ROWS = "layer STRING, y INT, features ARRAY<DOUBLE>, held ARRAY<BOOLEAN>, id INT"


def drawn(classes, seed=3, n=240, sizes=(("a", 3), ("b", 5), (None, 2))):
    rng = np.random.default_rng(seed)
    rows = []
    for layer, width in sizes:
        for i in range(n):
            y = int(rng.integers(classes))
            x = rng.normal(size=width) * 2 + 0.6 * y
            rows.append((layer, y, [float(v) for v in x], [bool(v) for v in rng.random(3) < 0.3], i))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(5).sortWithinPartitions("layer")


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_coefficients_equal_those_of_spark_ml(spark, classes):
    rows = frame(spark, drawn(classes))
    fits = fit_cells(rows.drop("id"), classes)
    assert len(fits) == 9
    for layer, repeat in (("a", 0), ("b", 2), (None, 1)):
        own = rows.filter(F.col("layer").eqNullSafe(layer) & ~F.get("held", F.lit(repeat)))
        model = LogisticRegression(
            featuresCol="x", labelCol="y", regParam=1.0 / own.count(), elasticNetParam=0.0, standardization=False,
            maxIter=500, tol=1e-12,
        ).fit(own.withColumn("x", array_to_vector("features")))
        got = fits[layer, repeat]
        np.testing.assert_allclose(got[:, 1:], model.coefficientMatrix.toArray(), atol=2e-5)
        intercepts = np.array(model.interceptVector.toArray())
        np.testing.assert_allclose(got[:, 0] - got[:, 0].mean(), intercepts - intercepts.mean(), atol=2e-5) if classes > 2 else (
            np.testing.assert_allclose(got[:, 0], intercepts, atol=2e-5)
        )


def test_fits_do_not_depend_on_the_partitions(spark):
    data = drawn(3)
    one = fit_cells(spark.createDataFrame(data, ROWS).drop("id").coalesce(1).sortWithinPartitions("layer"), 3)
    many = fit_cells(frame(spark, data).drop("id"), 3)
    for at in one:
        np.testing.assert_allclose(one[at], many[at], atol=1e-8)


def test_separable_and_single_class_cells_end(spark):
    rows = [("s", int(i >= 20), [float(i)], [False], i) for i in range(40)] + [("one", 1, [float(i)], [False], i) for i in range(9)]
    fits = fit_cells(frame(spark, rows).drop("id"), 2)
    held = frame(spark, [(a, b, c, [True], e) for a, b, c, _, e in rows])
    found = predict_cells(held, fits, ["y", "id"])
    assert found.count() == 49 and found.filter("predicted <> y").count() == 0


def test_number_of_jobs_does_not_grow_with_the_cells(spark):
    def jobs(layers, repeats):
        group = f"probe-{layers}-{repeats}"
        rows = [(f"l{k}", i % 2, [float((i * 7 + k) % 11), float(i % 5)], [bool((i + r) % 4 == 0) for r in range(repeats)], i) for k in range(layers) for i in range(40)]
        spark.sparkContext.setJobGroup(group, group)
        fit_cells(frame(spark, rows).drop("id"), 2)
        spark.sparkContext.setJobGroup("rest", "rest")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(8, 5) <= jobs(1, 1) + 12


def test_held_out_rows_without_label_or_features_are_left_out(spark):
    rows = [(i, "ab"[i % 2] if i % 9 else None, [float(i % 2), 1.0] if i % 7 else None, 0) for i in range(80)]
    df = spark.createDataFrame(rows, "id INT, label STRING, features ARRAY<DOUBLE>, layer INT")
    found = probe_predictions(df, "label", "features", "layer", "id", repeats=2).collect()
    assert found and all(r["id"] % 9 and r["id"] % 7 for r in found)
    assert all(r["true"] == r["predicted"] for r in found)


def test_newton_step_of_one_cell():
    x = np.hstack([np.ones((4, 1)), np.array([[0.0], [1.0], [2.0], [3.0]])])
    y = np.array([0, 0, 1, 1])
    weights = np.zeros((1, 2))
    for _ in range(30):
        loss, gain, step = newton_step(cell_sums(x, y, weights), weights, 1.0)
        weights = weights + step.reshape(1, 2)
    p = 1 / (1 + np.exp(-(x @ weights[0])))
    np.testing.assert_allclose(x.T @ (p - y) + [0, weights[0, 1]], 0, atol=1e-10)
    assert gain < 1e-12 and loss < 4 * np.log(2)
