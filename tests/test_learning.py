from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from turnwise.config import COLLINEAR_FEATURES
from turnwise.operators import gram as gram_module
from turnwise.operators import regression
from turnwise.operators.filters import binarize, known, min_group_size, without_outliers
from turnwise.operators.gram import contiguous_matrix, gram, merge
from turnwise.operators.importance import (
    families_of,
    family_importance,
    importance_change,
    short_name,
    top3_marks,
)
from turnwise.operators.lexicon import category_rates, concreteness
from turnwise.operators.probe import (
    better_layers,
    probe_predictions,
    probe_scores,
    with_dominance,
)
from turnwise.operators.ranking import (
    assign_fold,
    balance,
    global_rank,
    hold_out,
    sample_n,
    top_per_group,
)
from turnwise.operators.regression import (
    alpha_path,
    descend,
    elastic_net_cv,
    elastic_net_fit,
    elastic_net_grid,
    best_penalty,
    inflation,
    ols,
    standardise,
    vif_step,
)
from turnwise.operators.reshape import crosstab, dummies, levels
from turnwise.operators.scoring import best_label, score_batch, scores_to_columns
from turnwise.plans.explain import explain_outcome

XS = [f"x{i}" for i in range(4)]


def sample(n=160, p=4, seed=0, noise=0.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 1] = 0.6 * x[:, 0] + 0.8 * x[:, 1]
    y = 2 + x @ np.array([1.5, -1.0, 0.0, 0.2] + [0.0] * (p - 4)) + noise * rng.normal(size=n)
    return x, y


def frame(spark, x, y, names=XS):
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id BIGINT, " + ", ".join(f"{c} DOUBLE" for c in names) + ", y DOUBLE")


def test_standardise(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a", 1), (3.0, 5.0, "b", 2)], "v DOUBLE, c DOUBLE, s STRING, n INT")
    assert [tuple(r) for r in standardise(df).orderBy("s").collect()] == [(-1.0, 0.0, "a", -1.0), (1.0, 0.0, "b", 1.0)]
    by = standardise(df.withColumn("k", F.col("s")), ["v"], ["k"])
    assert [r.v for r in by.collect()] == [0.0, 0.0]


@pytest.mark.parametrize("columns", [12, 1])
def test_gram_both_ways(spark, monkeypatch, columns):
    monkeypatch.setattr(gram_module, "EXPRESSION_COLUMNS", columns)
    x, y = sample()
    df = assign_fold(frame(spark, x, y), "id", 3).repartition(5)
    extra = df.limit(1).withColumn("x0", F.lit(None).cast("double"))
    folds = gram(df.unionByName(extra), XS, "y", ["fold"])
    total = merge(folds, []).first()
    assert total.n == 160
    design = np.column_stack([np.ones(160), x, y])
    assert np.allclose(contiguous_matrix(total.moments), design.T @ design)
    assert np.allclose(sum(contiguous_matrix(r.moments) for r in folds.collect()), design.T @ design)


def test_ols_against_least_squares(spark):
    x, y = sample()
    fit = {r.feature: r for r in ols(frame(spark, x, y), "y", XS).collect()}
    expected, *_ = np.linalg.lstsq(np.column_stack([np.ones(160), x]), y, rcond=None)
    assert np.allclose([fit[c].coefficient for c in XS], expected[1:])
    assert math.isclose(fit["x0"].intercept, expected[0])
    residual = y - np.column_stack([np.ones(160), x]) @ expected
    assert math.isclose(fit["x0"].r2, 1 - (residual**2).sum() / ((y - y.mean()) ** 2).sum())


def test_ols_of_a_singular_design_has_minimum_norm(spark):
    x, y = sample()
    x = np.column_stack([x, x[:, 0]])
    names = [*XS, "copy"]
    fit = {r.feature: r.coefficient for r in ols(frame(spark, x, y, names), "y", names).collect()}
    assert math.isclose(fit["x0"], fit["copy"], rel_tol=1e-6)


def test_elastic_net_against_spark(spark):
    x, y = sample()
    df = frame(spark, x, y)
    alpha, l1_ratio = 0.2, 0.7
    penalty = spark.createDataFrame([(alpha, l1_ratio)], "alpha DOUBLE, l1_ratio DOUBLE")
    fit = {r.feature: r.coefficient for r in elastic_net_fit(gram(df, XS, "y"), penalty, XS).collect()}
    l1, l2, s = alpha * l1_ratio, alpha * (1 - l1_ratio), float(np.std(y, ddof=1))
    vectors = VectorAssembler(inputCols=XS, outputCol="features").transform(df)
    model = LinearRegression(
        labelCol="y", regParam=l1 + l2 * s, elasticNetParam=l1 / (l1 + l2 * s), standardization=False,
        tol=1e-12, maxIter=1000, solver="l-bfgs",
    ).fit(vectors)
    assert np.allclose([fit[c] for c in XS], model.coefficients.toArray(), atol=1e-5)


def test_descent_meets_the_optimality_conditions():
    x, y = sample(p=8, seed=2)
    z = np.column_stack([x, y])
    second = np.cov(z.T, ddof=0)
    for ratio in (0.1, 0.9, 1.0):
        for alpha in alpha_path(second, ratio, 5, 1e-2):
            w = descend(second, alpha, ratio, np.zeros(8))
            gradient = second[:-1, -1] - second[:-1, :-1] @ w - alpha * (1 - ratio) * w
            limit = alpha * ratio
            assert (np.abs(gradient) <= limit + 1e-7).all()
            assert np.allclose(gradient[w != 0], limit * np.sign(w[w != 0]), atol=1e-7)


def test_cross_validation_against_direct_fits(spark):
    x, y = sample(n=60)
    df = assign_fold(frame(spark, x, y), "id", 3, shuffle=False)
    moments = gram(df, XS, "y", ["fold"])
    grid = elastic_net_grid(moments, "fold", l1_ratios=[0.5, 1.0], n_alphas=6)
    rows = grid.collect()
    assert len(rows) == 3 * 2 * 6
    folds = np.repeat([0, 1, 2], 20)
    full = np.cov(np.column_stack([x, y]).T, ddof=0)
    for r in rows:
        train, test = folds != r.fold, folds == r.fold
        assert math.isclose(r.alpha, alpha_path(full, r.l1_ratio, 6, 1e-3)[r.alpha_index])
        second = np.cov(np.column_stack([x[train], y[train]]).T, ddof=0)
        w = descend(second, r.alpha, r.l1_ratio, np.zeros(4))
        intercept = y[train].mean() - x[train].mean(0) @ w
        assert math.isclose(r.mse, ((y[test] - intercept - x[test] @ w) ** 2).mean(), rel_tol=1e-6)
    errors = {}
    for r in rows:
        errors.setdefault((r.l1_ratio, r.alpha_index), []).append(r.mse)
    best = min(errors, key=lambda k: (np.mean(errors[k]), k))
    chosen = best_penalty(grid).first()
    assert chosen.l1_ratio == best[0] and math.isclose(chosen.mse, np.mean(errors[best]))
    fit = elastic_net_cv(df, "y", XS, "fold", l1_ratios=[0.5, 1.0], n_alphas=6)
    assert fit.count() == 4 and math.isclose(fit.first().alpha, chosen.alpha)


def test_elastic_net_per_analysis(spark):
    x, y = sample(n=60)
    one = frame(spark, x, y).withColumn("model", F.lit("m"))
    two = frame(spark, x, -y).withColumn("model", F.lit("n"))
    both = assign_fold(one.unionByName(two), "id", 3)
    fit = elastic_net_cv(both, "y", XS, "fold", ["model"], l1_ratios=[1.0], n_alphas=5)
    got = {(r.model, r.feature): r.coefficient for r in fit.collect()}
    assert len(got) == 8
    for c in XS:
        assert math.isclose(got[("m", c)], -got[("n", c)], abs_tol=1e-8)


def test_vif_step(spark):
    x, y = sample()
    names = [*XS, "sum", "flat"]
    x = np.column_stack([x, x[:, 0] + x[:, 2] + 1e-3 * np.random.default_rng(1).normal(size=160), np.zeros(160)])
    rows = {r.feature: r for r in vif_step(frame(spark, x, y, names), names, 10.0, intercept=True).collect()}
    dropped = [f for f, r in rows.items() if r.step is not None]
    # A constant is a combination of the intercept; of the other three one goes.
    assert dropped[0] != "flat" or rows["flat"].vif == math.inf
    dropped.remove("flat")
    assert len(dropped) == 1 and dropped[0] in ("x0", "x2", "sum") and rows[dropped[0]].vif > 1000
    kept = [c for c in names if c not in dropped and c != "flat"]
    z = x[:, [names.index(c) for c in kept]]
    correlation = np.corrcoef(z.T)
    assert np.allclose([rows[c].vif for c in kept], np.diag(np.linalg.inv(correlation)), rtol=1e-6)


@pytest.mark.parametrize("intercept", [False, True])
def test_sweeps_remove_what_new_inverses_remove(intercept):
    """200 columns, many of them combinations of others, nearly or exactly, and one without spread."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 200)) + 0.3
    for k in range(60):
        x[:, 100 + k] = x[:, k] + x[:, k + 1] + 10.0 ** -(k % 5) * rng.normal(size=900)
    x[:, 170], x[:, 171] = 3 * x[:, 5], 2.0
    full = np.column_stack([np.ones(900), x, np.zeros(900)])
    matrix, left, want = full.T @ full, list(range(200)), []
    factors = inflation(matrix, intercept)
    while factors.max() > 10.0:
        worst = int(factors.argmax())
        want.append((left.pop(worst), factors[worst]))
        matrix = np.delete(np.delete(matrix, worst + 1, 0), worst + 1, 1)
        factors = inflation(matrix, intercept)
    gone, kept = regression._removals(regression._correlations(full.T @ full, intercept), 10.0)
    assert [i for i, _ in gone] == [i for i, _ in want] and len(gone) > 40
    assert np.allclose([f for _, f in gone if f < 1e8], [f for _, f in want if f < 1e8], rtol=1e-6)
    assert [i for i, _ in kept] == left and np.allclose([f for _, f in kept], factors, rtol=1e-9)


def test_folds_in_order_of_any_key(spark):
    names = [None, None, *(f"n{i * 7919 % 1009}" for i in range(500)), "Ünder", ""]
    df = spark.createDataFrame([(n,) for n in names], "name STRING").repartition(9)
    got = sorted(((r.name is not None, (r.name or "").encode()), r.fold) for r in assign_fold(df, "name", 7, shuffle=False).collect())
    assert [fold for _, fold in got] == [i // 72 for i in range(504)]
    ranks = [(r.name, r._position) for r in global_rank(df, "name").collect()]
    assert sorted(p for _, p in ranks) == list(range(504)) and {p for n, p in ranks if n is None} == {0, 1}
    assert assign_fold(df.limit(0), "name", 7, shuffle=False).count() == 0


def test_exact_copies_have_infinite_inflation(spark):
    x, y = sample()
    names = [*XS, "copy"]
    x = np.column_stack([x, 2 * x[:, 3]])
    rows = {r.feature: r for r in vif_step(frame(spark, x, y, names), names).collect()}
    dropped = [r for r in rows.values() if r.step is not None]
    assert [r.feature in ("x3", "copy") for r in dropped] == [True] and math.isinf(dropped[0].vif)


def test_families(spark):
    names = {
        "dummy_topic_jobs": ["topic"],
        "dummy_topic_language": ["topic", "demographic"],
        "dummy_age_18-24": ["demographic"],
        "e_joy_user_prompt": ["emotion"],
        "politeness_user_prompt": ["politeness"],
        "user_prompt_liwc_Tone": ["liwc"],
        "num_tokens_model_response": ["linguistic"],
    }
    df = spark.createDataFrame([(n,) for n in names], "feature STRING")
    got = {r.feature: list(r.f) for r in df.select("feature", families_of(F.col("feature"), ["age"]).alias("f")).collect()}
    assert got == names
    long = spark.createDataFrame([("dummy_" + "x" * 60,)], "feature STRING")
    assert long.select(short_name(F.col("feature"))).first()[0] == "x" * 50


def test_importance_change_and_marks(spark, rows):
    full = spark.createDataFrame([("k", "age_a", 2.0), ("k", "age_b", 0.0), ("k", "topic_x", 5.0)], "k STRING, feature STRING, coefficient DOUBLE")
    reduced = spark.createDataFrame([("k", "age_a", -4.0), ("k", "age_b", 1.0), ("k", "age_c", 0.0)], "k STRING, feature STRING, coefficient DOUBLE")
    assert rows(importance_change(full, reduced, ["k"], ["age"])) == [("k", -75.0, 2)]
    table = family_importance(full, ["k"], ["age"])
    got = {r.family: (r.max_importance, r.mean_importance) for r in table.collect()}
    assert got["topic"] == (5.0, 5.0) and got["demographic"] == (2.0, 2.0) and got["emotion"] == (0.0, 0.0)
    marks = {(r.measure, r["rank"]): r.family for r in top3_marks(table, ["k"]).collect()}
    assert len(marks) == 6 and marks[("max", 1)] == "topic" and marks[("mean", 2)] == "demographic"


def skewed(spark, n=400):
    """Two thirds of the rows are of one class."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 9 == 2, "rare").otherwise("mid").alias("c"))


def test_balance_and_samples(spark):
    df = skewed(spark)
    sizes = {r.c: r["count"] for r in df.groupBy("c").count().collect()}
    out = balance(df, "c", "id", 3)
    assert {r.c: r["count"] for r in out.groupBy("c").count().collect()} == {c: min(sizes.values()) for c in sizes}
    assert out.distinct().count() == out.count()
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(out) == ids(balance(df.repartition(9), "c", "id", 3)) != ids(balance(df, "c", "id", 4))
    drawn = {r.c: r["count"] for r in sample_n(df, ["c"], "id", 60).groupBy("c").count().collect()}
    assert drawn == {c: min(60, n) for c, n in sizes.items()}


def test_folds(spark):
    df = spark.range(23).select((F.col("id") * 7 % 23).alias("id"))
    got = {r.id: r.fold for r in assign_fold(df, "id", 5, shuffle=False).collect()}
    expected = np.concatenate([np.full(len(p), i) for i, p in enumerate(np.array_split(np.arange(23), 5))])
    assert [got[i] for i in range(23)] == list(expected)
    few = {r.id: r.fold for r in assign_fold(spark.range(2), "id", 5, shuffle=False).collect()}
    assert few == {0: 0, 1: 1}
    ranks = {r.id: r._position for r in global_rank(df, "id").collect()}
    assert ranks == {i: i for i in range(23)}
    share = spark.range(4000).filter(hold_out("id", 2)).count() / 4000
    assert abs(share - 0.25) < 0.03


def test_top_per_group(spark, rows):
    df = spark.range(300).select((F.col("id") % 2).alias("k"), "id")
    got = top_per_group(df, ["k"], 2, [F.col("id").desc()], F.col("id"))
    assert rows(got.select("k", "id", "rank")) == [(0, 296, 2), (0, 298, 1), (1, 297, 2), (1, 299, 1)]


def test_filters(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",), ("Other",)], "g STRING")
    assert rows(min_group_size(df, ["g"])) == sorted([("a",), ("a",), (None,), (None,)], key=repr)
    assert rows(known(df, "g")) == [("a",), ("a",), ("b",)]
    assert without_outliers(df.withColumnRenamed("g", "topic"), marker="a").count() == 4
    ages = spark.createDataFrame([("18-24 years old",), ("65+ years old",), ("35-44 years old",), (None,)], "age STRING")
    assert rows(binarize(ages, "age")) == [(0,), (1,)]
    education = spark.createDataFrame([("Some Primary",), ("Vocational",), ("Graduate / Professional degree",)], "education STRING")
    assert rows(binarize(education, "education")) == [(0,), (1,)]


def test_dummies_and_crosstab(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i INT, g STRING")
    assert rows(dummies(df, ["g"])) == [(1, 1, 0), (2, 0, 0), (3, 0, 1)]
    assert dummies(df, ["g"]).columns == ["i", "dummy_g_a", "dummy_g_b"]
    assert rows(crosstab(df, "i", "g")) == [(1, 1, 0), (3, 0, 1)]
    with pytest.raises(ValueError):
        levels(df, "i", limit=2)


def test_lexicon_features(spark):
    texts = spark.createDataFrame([(1, "Dog dog 7 cat."), (2, ""), (3, "dog")], "i INT, user_prompt STRING")
    lexicon = spark.createDataFrame([("dog", "pet", 4.0), ("cat", "pet", 5.0), ("cat", "small", 5.0)], "word STRING, category STRING, weight DOUBLE")
    ratings = lexicon.filter("category = 'pet'")
    got = {r.i: r[1] for r in concreteness(texts, ["i"], "user_prompt", ratings, F.col("i") != 3).collect()}
    assert math.isclose(got[1], 3.0) and got[2] is None and got[3] is None
    rates = {r.i: (r[1], r[2]) for r in category_rates(texts, ["i"], "user_prompt", lexicon, ["pet", "small"]).collect()}
    assert rates[1] == (0.4, 0.2) and rates[2] == (None, None) and rates[3] == (1.0, 0.0)


def test_score_batch(spark):
    def load():
        import pandas as pd

        return lambda s: pd.DataFrame({"scores": [{"a": float(len(v)), "b": 2.0} for v in s]})

    df = spark.createDataFrame([(1, "xyz"), (2, "x")], "i INT, t STRING")
    scored = score_batch(df, "t", load, "scores MAP<STRING, DOUBLE>", ["i"])
    got = {r.i: r for r in scores_to_columns(scored.withColumn("top", best_label(F.col("scores"))), "scores", ["a", "z"], "e_", "t").collect()}
    assert (got[1].e_a_t, got[1].e_z_t, got[1].top) == (3.0, None, "a") and got[2].top == "b"


def test_probe_separable_layer(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(120):
        label = "ab"[i % 2]
        data.append((f"c{i}", label, 0, [float(v) for v in rng.normal(size=3)]))
        data.append((f"c{i}", label, 1, [float(v + 3 * (i % 2)) for v in rng.normal(size=3)]))
    df = spark.createDataFrame(data, "id STRING, label STRING, layer INT, features ARRAY<FLOAT>")
    predictions = probe_predictions(df, "label", "features", "layer", "id", repeats=3)
    scores = probe_scores(predictions, "layer", "id")
    assert scores.count() == 6
    better = {r.layer: r for r in better_layers(with_dominance(scores, ["layer"]), ["layer"]).collect()}
    assert better[1].better and better[1].mean_f1 > 0.9 and better[0].mean_f1 < 0.8


def test_explain_outcome(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(200):
        topic, gender = f"t{i % 4}", "fm"[i // 4 % 2]
        tokens, joy = rng.normal(), rng.normal()
        data.append((i, gender, topic, float(tokens), float(joy), 1.0, float(5 * (i % 4 == 0) + joy + 0.1 * rng.normal())))
    data.append((200, "f", "alone", 0.0, 0.0, 1.0, 99.0))
    data.append((201, None, "t0", 0.0, 0.0, 1.0, 5.0))
    data.append((202, "f", "t0", 0.0, 0.0, 1.0, None))
    schema = "id BIGINT, gender STRING, topic STRING, num_sents_x_user_prompt DOUBLE, e_joy_user_prompt DOUBLE, num_tokens_user_prompt DOUBLE, y DOUBLE"
    df = spark.createDataFrame(data, schema)
    features = ["num_sents_x_user_prompt", "e_joy_user_prompt", "num_tokens_user_prompt"]
    out = explain_outcome(df, "y", features, ["gender"], "topic", "id")
    fit = {r.feature: r for r in out.elastic_net.collect()}
    least = {r.feature: r for r in out.ols.collect()}
    # Least squares leaves collinear features and rows without a group out, the elastic net neither.
    assert "num_tokens_user_prompt" in COLLINEAR_FEATURES and "num_tokens_user_prompt" not in least
    assert set(fit) == {*least, "num_tokens_user_prompt"}
    assert {r.n for r in least.values()} == {200} and {r.n for r in fit.values()} == {201}
    assert "dummy_topic_alone" not in fit and fit["dummy_topic_t0"].coefficient > 1 and fit["e_joy_user_prompt"].r2 > 0.95
    reduced = {r.feature for r in out.without_topic.collect()}
    assert reduced == {f for f in fit if not f.startswith("dummy_topic_")}
    families = {r.family: r.max_importance for r in out.families.collect()}
    assert families["topic"] > families["demographic"]
    assert out.change.count() <= 1
