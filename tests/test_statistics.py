from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions.tails import (
    chi2_tail,
    chi2_tail_value,
    f_tail,
    f_tail_value,
    t_tail_value,
)
from turnwise.operators.aggregates import (
    class_summary,
    conversation_means,
    group_means,
    group_spread,
    mean_ci,
    mean_ci_bootstrap,
    moments,
)
from turnwise.operators.classification import (
    class_scores,
    confusion_counts,
    confusion_matrix,
    majority_baseline,
    random_baseline,
    summary_scores,
)
from turnwise.operators import dominance
from turnwise.operators.dominance import aso, draw_ranks, violation
from turnwise.operators.pairs import pair_table
from turnwise.operators.tests_of_difference import (
    anova,
    anova_from_stats,
    chi2_one_vs_rest,
    significant,
    ttest_from_stats,
    with_f_tail,
    with_t_tail,
)


@pytest.mark.parametrize(
    "f, d1, d2, p",
    [(4.964603, 1, 10, 0.05), (10.04429, 1, 10, 0.01), (3.098391, 3, 20, 0.05), (2.75871, 5, 25, 0.04)],
)
def test_f_tail_against_tables(f, d1, d2, p):
    got = float(f_tail_value(f, d1, d2))
    assert abs(got - p) < (2e-6 if p != 0.04 else 2e-3)


def test_other_tails_against_tables():
    for t, df, p in [(2.228139, 10, 0.05), (1.959964, 10**7, 0.05), (63.65674, 1, 0.01), (0.0, 5, 1.0)]:
        assert abs(float(t_tail_value(t, df)) - p) < 1e-6
    for x, df, p in [(3.841459, 1, 0.05), (18.30704, 10, 0.05), (2.0, 2, math.exp(-1)), (0.0, 3, 1.0), (200.0, 2, math.exp(-100))]:
        assert math.isclose(float(chi2_tail_value(x, df)), p, rel_tol=2e-5, abs_tol=1e-60)
    # F with (1, d) is t²; a tail far out keeps its relative accuracy.
    assert math.isclose(float(f_tail_value(900.0, 1, 40)), float(t_tail_value(30.0, 40)), rel_tol=1e-9)


def test_tails_keep_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (1.0, 1.0)], "a DOUBLE, b DOUBLE")
    got = [r[0] for r in df.select(chi2_tail(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [None, None] and abs(got[2] - 0.317311) < 1e-6
    assert df.select(f_tail(F.col("a"), F.col("b"), F.lit(3.0))).first()[0] is None


def grouped(spark):
    data = [("x", g, float(v)) for g, vs in {"a": [1, 2, 3], "b": [2, 3, 4], "c": [5, 6, 7]}.items() for v in vs]
    data += [("one", "a", 1.0), ("one", "a", 2.0), ("x", "c", None)]
    data += [("flat", "a", 1.0), ("flat", "b", 1.0), ("flat", "a", 1.0)]
    return spark.createDataFrame(data, "k STRING, g STRING, v DOUBLE")


def test_anova_by_hand(spark):
    table = {r.k: r for r in with_f_tail(anova(grouped(spark), ["k"], "g", "v")).collect()}
    x = table["x"]
    assert (x.n_total, x.df_between, x.df_within, x.status) == (9, 2, 6, "ok")
    assert math.isclose(x.ss_between, 26.0) and math.isclose(x.ss_within, 6.0) and math.isclose(x.F, 13.0)
    assert math.isclose(x.diff_mean, 4.0) and abs(x.p_value - 0.006592) < 1e-5
    assert table["one"].status == "single_group" and table["one"].F is None and table["one"].p_value is None
    assert table["flat"].F is None and table["flat"].status == "no_variance"


def test_anova_without_spread_is_certain(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 1.0), ("k", "b", 0.0), ("k", "b", 0.0)], "k STRING, g STRING, v DOUBLE")
    row = with_f_tail(anova(df, ["k"], "g", "v")).first()
    assert row.F == math.inf and row.p_value == 0.0 and row.status == "ok" and row.diff_mean == 1.0


def test_tails_reach_their_limits():
    for df in (1e8, 1e9, 1e12, 1e15, 1e18):
        assert math.isclose(float(t_tail_value(1.959963984540054, df)), 0.05, rel_tol=1e-6)
        assert math.isclose(float(f_tail_value(3.0, 2, df)), math.exp(-3), rel_tol=1e-6)


def test_anova_from_stats_equals_anova_and_flags(spark):
    df = grouped(spark).filter("k = 'x' AND v IS NOT NULL")
    direct = anova(df, ["k"], "g", "v").first()
    summary = anova_from_stats(group_means(df, ["k"], "g", "v"), ["k"], min_n=2).first()
    assert math.isclose(direct.F, summary.F)
    bad = spark.createDataFrame(
        [("s", 1, 1.0, 0.0), ("s", 5, 1.0, 1.0), ("v", 5, 1.0, -1.0), ("v", 5, 2.0, 1.0)],
        "k STRING, n BIGINT, mean DOUBLE, var DOUBLE",
    )
    status = {r.k: r.status for r in anova_from_stats(bad, ["k"], min_n=2).collect()}
    assert status == {"s": "small_group", "v": "negative_variance"}


def test_significance_nulls_effects(spark):
    df = spark.createDataFrame([(0.001, 5.0), (0.5, 7.0), (None, 9.0)], "p_value DOUBLE, diff_mean DOUBLE")
    assert [(r["diff"], r.diff_mean) for r in significant(df).collect()] == [(True, 5.0), (False, None), (False, None)]
    assert significant(df, null_insignificant=False).collect()[1].diff_mean == 7.0


def chi2_by_hand(table):
    table = np.asarray(table, float)
    expected = np.outer(table.sum(1), table.sum(0)) / table.sum()
    off = np.abs(table - expected)
    if table.shape == (2, 2):
        off = off - np.minimum(off, 0.5)
    return (off**2 / expected).sum()


@pytest.mark.parametrize("groups", ["ab", "abc"])
def test_chi2_with_absent_cells(spark, groups):
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, size=(4, len(groups)))
    counts[0, 0] = counts[1, 1] = 0
    counts[2] = counts[2] + 5
    data = [("d", f"t{i}", g, int(counts[i, j])) for i in range(4) for j, g in enumerate(groups) if counts[i, j]]
    df = spark.createDataFrame(data, "demo STRING, topic STRING, grp STRING, n BIGINT")
    for r in chi2_one_vs_rest(df, ["demo"], "topic", "grp", "n").collect():
        row = counts[int(r.topic[1])]
        assert math.isclose(r.statistic, chi2_by_hand([row, counts.sum(0) - row]), rel_tol=1e-9), r
        assert r.df == len(groups) - 1


def test_chi2_impossible(spark):
    one_group = spark.createDataFrame([("t", "a"), ("u", "a")], "topic STRING, grp STRING")
    assert {r.status for r in chi2_one_vs_rest(one_group, [], "topic", "grp").collect()} == {"single_group"}
    one_topic = spark.createDataFrame([("t", "a"), ("t", "b")], "topic STRING, grp STRING")
    row = chi2_one_vs_rest(one_topic, [], "topic", "grp").first()
    assert (row.status, row.statistic) == ("single_topic", None)


def test_ttest_by_hand(spark):
    cells = spark.createDataFrame([("p", 5.0, 2.0, 10), ("q", 3.0, 3.0, 20)], "cell STRING, mean DOUBLE, sd DOUBLE, n BIGINT")
    row = with_t_tail(ttest_from_stats(cells, pairs=[("p", "q")])).first()
    pooled = (9 * 4 + 19 * 9) / 28
    assert math.isclose(row.t, 2 / math.sqrt(pooled * (1 / 10 + 1 / 20))) and row.df == 28
    assert 0.05 < row.p_value < 0.1


def pairs_by_hand(data, columns, demographics, markers, unordered):
    cells = {}
    for demo in demographics:
        d = columns.index(demo)
        rows = [r for r in data if r[d] is not None and r[d] not in markers
                and r[-2] not in (None, "Outliers") and r[-1] is not None]
        for (i, a), (j, b) in itertools.product(enumerate(rows), repeat=2):
            if unordered and i >= j:
                continue
            cell = ("same" if a[d] == b[d] else "diff") + "_group_" + ("same" if a[-2] == b[-2] else "diff") + "_topic"
            cells.setdefault(cell, []).append(abs(a[-1] - b[-1]))
    return {c: (len(v), float(np.mean(v)), float(np.var(v, ddof=1))) for c, v in cells.items()}


@pytest.mark.parametrize("unordered", [False, True])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_pair_table_equals_brute_force(spark, unordered, offset):
    rng = np.random.default_rng(0)
    # One topic holds a third of all rows, and values are tied.
    topics = ["hot"] * 40 + [["t1", "t2", "t3", "Outliers", None][i] for i in rng.integers(0, 5, 80)]
    data = [
        (
            [None, "Other", "a", "b", "c"][rng.integers(0, 5)],
            ["x", "y"][rng.integers(0, 2)],
            t,
            None if i % 17 == 0 else offset + float(rng.integers(0, 12)) / 4,
        )
        for i, t in enumerate(topics)
    ]
    columns = ["g1", "g2", "topic", "v"]
    df = spark.createDataFrame(data, "g1 STRING, g2 STRING, topic STRING, v DOUBLE")
    got = {r.cell: r for r in pair_table(df, ["g1", "g2"], "topic", "v", unordered=unordered).collect()}
    expected = pairs_by_hand(data, columns, ["g1", "g2"], ["Other", "Unknown", "Prefer not to say"], unordered)
    assert set(got) == set(expected)
    for cell, (n, mean, var) in expected.items():
        assert got[cell].n == n
        assert math.isclose(got[cell].mean, mean, rel_tol=1e-9)
        assert math.isclose(got[cell].var, var, rel_tol=1e-7)


def test_pair_table_per_analysis(spark):
    df = spark.createDataFrame(
        [(m, "ab"[i % 2], "tu"[i // 2 % 2], float(i * k)) for m, k in (("m", 1), ("n", 2)) for i in range(12)],
        "model STRING, g STRING, topic STRING, v DOUBLE",
    )
    got = {(r.model, r.cell): r.mean for r in pair_table(df, ["g"], "topic", "v", by=["model"]).collect()}
    assert len(got) == 8
    for (model, cell), mean in got.items():
        if model == "n":
            assert math.isclose(mean, 2 * got[("m", cell)])


def test_pair_table_in_many_ranges_and_batches(spark):
    """Half of all rows have one value, which then lies in several ranges; null analyses are one analysis."""
    rng = np.random.default_rng(3)
    data = [
        (None if i % 3 else "m", f"g{rng.integers(0, 9)}", f"t{rng.integers(0, 9)}", 7.5 if i % 2 else float(rng.integers(-40, 40)))
        for i in range(600)
    ]
    df = spark.createDataFrame(data, "model STRING, g STRING, topic STRING, v DOUBLE")
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": "11", "spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = {(r.model, r.cell): r for r in pair_table(df, ["g"], "topic", "v", by=["model"]).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for model in (None, "m"):
        of_model = [r[1:] for r in data if r[0] == model]
        expected = pairs_by_hand(of_model, ["g", "topic", "v"], ["g"], [], False)
        assert len(expected) == 4
        for cell, (n, mean, var) in expected.items():
            row = got.pop((model, cell))
            assert row.n == n and math.isclose(row.mean, mean, rel_tol=1e-9) and math.isclose(row.var, var, rel_tol=1e-9)
    assert not got


def test_pair_table_of_nothing(spark):
    none = spark.createDataFrame([(None, "t", 1.0), ("a", None, 1.0), ("a", "t", None)], "g STRING, topic STRING, v DOUBLE")
    assert pair_table(none, ["g"], "topic", "v").count() == 0


LABELS = [("a", "a"), ("a", "b"), ("a", "a"), ("b", "b"), ("b", "c"), ("a", None), (None, "a")]


def test_confusion_and_scores(spark):
    df = spark.createDataFrame(LABELS, "t STRING, p STRING")
    cells = {(r.true, r.predicted): (r.n, r.share) for r in confusion_matrix(df, [], "t", "p").collect()}
    assert len(cells) == 9 and sum(n for n, _ in cells.values()) == 5
    assert cells[("a", "a")][0] == 2 and math.isclose(cells[("a", "a")][1], 2 / 3)
    assert cells[("c", "a")] == (0, None)
    counts = confusion_counts(df, [], "t", "p")
    scores = {r.label: r for r in class_scores(counts, []).collect()}
    assert (scores["a"].precision, scores["a"].recall) == (1.0, 2 / 3) and math.isclose(scores["a"].f1, 0.8)
    assert (scores["c"].precision, scores["c"].recall, scores["c"].f1, scores["c"].support) == (0, 0, 0, 0)
    total = summary_scores(counts, []).first()
    assert math.isclose(total.micro_f1, 0.6) and math.isclose(total.macro_f1, (0.8 + 0.5 + 0) / 3)
    assert math.isclose(total.weighted_f1, (0.8 * 3 + 0.5 * 2) / 5)


def test_baselines(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "g") for i in range(40)], "i INT, t STRING, k STRING")
    assert {r.majority for r in majority_baseline(df, ["k"], "t").collect()} == {"a"}
    first = {r.i: r.random for r in random_baseline(df, ["k"], "t", "i", 1).collect()}
    again = {r.i: r.random for r in random_baseline(df.repartition(7), ["k"], "t", "i", 1).collect()}
    assert first == again and set(first.values()) == {"a", "b"}
    summary = class_summary(df, ["k"], "t").first()
    assert (summary.min_size, summary.n_classes, summary.majority) == (20, 2, "a")


def test_weighted_rows_stand_for_as_many(spark, rows):
    data = [("g", "x", "y", 1.0, 2.0, 3), ("g", "x", "x", 4.0, 2.0, 5), (None, "y", "y", 3.0, 3.5, 2), ("g", "y", None, None, 1.0, 4)]
    columns = "k STRING, t STRING, p STRING, a DOUBLE, b DOUBLE, n BIGINT"
    weighted = spark.createDataFrame(data, columns)
    expanded = spark.createDataFrame([r for r in data for _ in range(r[-1])], columns)
    assert rows(confusion_counts(weighted, ["k"], "t", "p", "n")) == rows(confusion_counts(expanded, ["k"], "t", "p"))
    scores = [rows(aso(df, ["k"], "a", "b", seed=3, replicates=50, weight=w)) for df, w in ((weighted, "n"), (expanded, None))]
    assert scores[0] == scores[1] and len(scores[0]) == 2


def test_means_skip_nan_and_null_keys(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), (None, 9.0), ("b", None)], "k STRING, v DOUBLE")
    assert rows(conversation_means(df, ["k"], ["v"])) == [("a", 2.0), ("b", None)]


def test_intervals(spark):
    values = [float(v) for v in range(100)]
    df = spark.createDataFrame([("k", v) for v in values] + [(None, 1.0)], "k STRING, v DOUBLE")
    normal = mean_ci(df, ["k"], "v").filter("k = 'k'").first()
    half = 1.96 * np.std(values, ddof=1) / 10
    assert math.isclose(normal.low, 49.5 - half) and math.isclose(normal.high, 49.5 + half)
    drawn = mean_ci_bootstrap(df, ["k"], "v", seed=1)
    boot = drawn.filter("k = 'k'").first()
    assert boot.n == 100 and math.isclose(boot.mean, 49.5)
    assert abs(boot.low - normal.low) < 1.2 and abs(boot.high - normal.high) < 1.2
    again = mean_ci_bootstrap(df.repartition(5), ["k"], "v", seed=1).filter("k = 'k'").first()
    assert math.isclose(boot.low, again.low) and drawn.count() == 2


def test_group_spread(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 3.0), ("k", "b", 7.0)], "k STRING, g STRING, v DOUBLE")
    assert group_spread(df, ["k"], "g", "v").first().diff_mean == 5.0


def test_bootstrap_ranks_are_order_statistics():
    ranks = draw_ranks(5, 0.2, 4000, 1)
    assert list(ranks[0]) == [1, 2, 3, 4]
    # P(the smallest of five draws is the smallest value) = 1 − (4/5)^5.
    assert abs((ranks[1:, 0] == 1).mean() - (1 - 0.8**5)) < 0.03
    assert (np.diff(ranks, axis=1) >= 0).all() and ranks.min() == 1 and ranks.max() == 5


def test_violation_ratio():
    low, high = np.array([1.0, 2.0, 3.0]), np.array([2.0, 3.0, 4.0])
    assert violation(high, low) == 0.0 and violation(low, high) == 1.0 and violation(low, low) == 0.5
    assert math.isclose(violation(np.array([0.0, 3.0]), np.array([1.0, 1.0])), 1 / 5)


def test_aso_both_ways(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(300):
        x = float(rng.normal())
        data += [("better", x + 3, float(rng.normal())), ("same", x, float(rng.normal())), ("worse", x - 3, float(rng.normal()))]
    df = spark.createDataFrame(data, "k STRING, a DOUBLE, b DOUBLE")
    got = {r.k: r for r in aso(df, ["k"], "a", "b", seed=42).collect()}
    assert got["better"].aso < 0.05 and got["worse"].aso == 1.0 and got["same"].aso > 0.2
    assert all(got[k].n_first == 300 for k in got)
    # A null key is a key, and an analysis without a value on one side is none.
    odd = df.filter("k = 'same'").withColumn("k", F.lit(None).cast("string")).unionByName(
        spark.createDataFrame([("empty", 1.0, None)], "k STRING, a DOUBLE, b DOUBLE")
    )
    row, = aso(odd, ["k"], "a", "b", seed=42).collect()
    assert row.k is None and math.isclose(row.violation, got["same"].violation) and abs(row.aso - got["same"].aso) < 0.2
    binary = spark.createDataFrame([("k", float(i % 10 < 8), float(i % 10 < 3)) for i in range(1000)], "k STRING, a DOUBLE, b DOUBLE")
    assert aso(binary, ["k"], "a", "b").first().aso == 0.0


def sorted_draws(spark, values, key, side, seed, replicates):
    """Bootstrap quantiles of a sample by indexing its sorted values."""
    drawn = spark.range(1).select(F.xxhash64(F.lit(seed), F.lit(key), F.lit(side))).first()[0]
    return np.sort(values)[draw_ranks(len(values), 0.005, replicates, drawn & 0xFFFFFFFFFFFFFFFF) - 1]


@pytest.mark.parametrize("range_values", [1 << 19, 7])
def test_aso_equals_sorted_samples(spark, monkeypatch, range_values):
    """Samples of any size and in any number of ranges; ties and unequal sizes."""
    monkeypatch.setattr(dominance, "RANGE_VALUES", range_values)
    rng = np.random.default_rng(8)
    samples = {
        "ties": (rng.integers(0, 6, 90).astype(float), rng.integers(1, 5, 90).astype(float)),
        "sizes": (rng.normal(size=31), rng.normal(0.3, 2, size=90)), "single": (np.array([1.5]), rng.normal(size=90)),
    }
    rows = []
    for k, (a, b) in samples.items():
        rows += [(k, float(a[i]) if i < len(a) else None, float(b[i])) for i in range(90)]
    df = spark.createDataFrame(rows, "k STRING, a DOUBLE, b DOUBLE").repartition(3)
    got = {r.k: r for r in aso(df, ["k"], "a", "b", seed=4, replicates=200).collect()}
    for k, (a, b) in samples.items():
        share = violation(*(sorted_draws(spark, v, k, side, 4, 200) for v, side in ((a, "a"), (b, "b"))))
        assert (got[k].n_first, got[k].n_second) == (len(a), len(b))
        assert math.isclose(got[k].violation, share[0], abs_tol=1e-12)
        bound = share[0] - share[1:].std() * NormalDist().inv_cdf(0.05)
        assert math.isclose(got[k].aso, min(max(bound, 0.0), 1.0), abs_tol=1e-9)


def test_nan_is_skipped_like_null(spark):
    """As pandas does: in moments, group means, intervals, the bootstrap and ANOVA."""
    rows = [("k", "a", 1.0), ("k", "a", 2.0), ("k", "b", 4.0), ("k", "b", 7.0)]
    odd = [("k", "a", float("nan")), ("k", "b", None), ("k", "c", float("nan"))]
    plain, mixed = (spark.createDataFrame(r, "k STRING, g STRING, v DOUBLE") for r in (rows, rows + odd))
    for summary in (
        lambda df: moments(df, ["k"], "v"), lambda df: mean_ci(df, ["k"], "v"), lambda df: group_spread(df, ["k"], "g", "v"),
        lambda df: mean_ci_bootstrap(df, ["k"], "v", replicates=50), lambda df: anova(df, ["k"], "g", "v"),
    ):
        assert summary(mixed).collect() == summary(plain).collect()
    assert anova(mixed, ["k"], "g", "v").first().status == "ok"
