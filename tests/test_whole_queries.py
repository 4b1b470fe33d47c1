"""Registered queries against brute force over all rows of the test tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.catalog import QUERIES, learning, statistics
from turnwise.catalog.registry import Tables
from turnwise.operators.ranking import assign_fold
from turnwise.operators.regression import alpha_path, descend, standardise
from turnwise.operators.reshape import dummies

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_inferred_labels_of_all_conversations(spark):
    t = Tables(spark, FOLDER)
    people = t.outcomes.select("conversation_id", "segment", "status").collect()
    want = Counter()
    for r in people:
        off = r.conversation_id % 3 == 0
        want["status", r.status, ("F" if r.status != "F" else "O") if off else r.status] += 1
        if r.segment != "HOUSEHOLD":
            want["segment", r.segment, "BUILDING" if off else r.segment] += 1
    got = statistics._inferred(t).groupBy("demo", "true", "predicted").count().collect()
    assert {(r.demo, r.true, r.predicted): r["count"] for r in got} == want
    scores = {r.demo: r.f1 for r in QUERIES["st8_inference_scores"](spark, FOLDER).collect()}
    for demo in ("status", "segment"):
        total = sum(n for (d, *_), n in want.items() if d == demo)
        assert math.isclose(scores[demo], sum(n for (d, a, p), n in want.items() if d == demo and a == p) / total)


def test_refit_without_topics_searches_the_whole_grid(spark, monkeypatch):
    made = []
    grid_of = learning.elastic_net_grid

    def watched(*args, **options):
        made.append(grid_of(*args, **options))
        return made[-1]

    monkeypatch.setattr(learning, "elastic_net_grid", watched)
    got = QUERIES["ml5_refit_without_topics"](spark, FOLDER).first()
    ratios = [0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0]
    searched = made[0].select("l1_ratio", "alpha_index", "fold").collect()
    assert sorted(searched) == [(r, i, f) for r in ratios for i in range(100) for f in range(5)]

    # The dense one-hot matrix, which the query never builds.
    lines = learning._lines(Tables(spark, FOLDER))
    coded = dummies(standardise(lines, learning.REGRESSORS), ["topic", "age"])
    xs = [*learning.REGRESSORS, *[c for c in coded.columns if c.startswith("dummy_")]]
    rows = assign_fold(coded, "l_orderkey", 5, 42)
    data = rows.select("fold", *(F.col(c).cast("double") for c in [*xs, learning.TARGET])).toPandas()
    fold, z = data["fold"].to_numpy(), data[[*xs, learning.TARGET]].to_numpy()
    second = np.cov(z.T, ddof=0)
    best = None
    for ratio in ratios:
        alphas = alpha_path(second, ratio, 100, 1e-3)
        errors = np.zeros((5, 100))
        for k in range(5):
            train, test = z[fold != k], z[fold == k]
            w = np.zeros(len(xs))
            for i, alpha in enumerate(alphas):
                w = descend(np.cov(train.T, ddof=0), alpha, ratio, w)
                off = train[:, -1].mean() - train[:, :-1].mean(0) @ w
                errors[k, i] = ((test[:, -1] - off - test[:, :-1] @ w) ** 2).mean()
        mean = errors.mean(0)
        i = int(mean.argmin())
        if best is None or mean[i] < best[0]:
            best = mean[i], ratio, alphas[i]
    _, ratio, alpha = best
    kept = [i for i, x in enumerate(xs) if not x.startswith("dummy_topic_")]
    full = dict(zip(xs, descend(second, alpha, ratio, np.zeros(len(xs)))))
    at = [*kept, len(xs)]
    reduced = dict(zip([xs[i] for i in kept], descend(second[np.ix_(at, at)], alpha, ratio, np.zeros(len(kept)))))
    ages = [x for x, w in reduced.items() if "age" in x.split("dummy_")[-1] and w]
    change = [100 * (abs(full[x]) - abs(reduced[x])) / abs(reduced[x]) for x in ages]
    assert got.n_features == len(ages) and math.isclose(got.median_change, np.median(change), rel_tol=1e-6, abs_tol=1e-6)
