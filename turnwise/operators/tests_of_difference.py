"""Analysis of variance, chi-square and t-tests on grouped summaries.

Each takes any number of analyses at once (``by``): one aggregation over the data, then arithmetic
on tables with a row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.config import ALPHA_GROUPS
from turnwise.functions.numeric import clean, ratio
from turnwise.functions.tails import chi2_tail, f_tail, t_tail
from turnwise.operators.aggregates import group_means, null_safe_join


def anova_from_stats(
    groups: DataFrame, by: Sequence[str], n: str = "n", mean: str = "mean", var: str = "var",
    min_n: int = 1,
) -> DataFrame:
    """The full one-way table from (n, mean, sample variance) per group.

    ``status`` names what makes a test impossible: fewer than two groups, a group below ``min_n``
    rows, a negative variance, or no spread at all. The statistics are then null. Without spread
    within groups whose means differ, F is infinite and its probability 0.
    """
    by = list(by)
    size, center = F.col(n), F.col(mean)
    # One row per group: a window over them costs the shuffle the next aggregation needs anyway.
    analysis = Window.partitionBy(*by)
    grand = F.sum(size * center).over(analysis) / F.sum(size).over(analysis)
    joined = groups.withColumn("_grand", grand)
    spread = (size - 1) * F.coalesce(F.col(var), F.lit(0.0))
    table = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(size).alias("n_total"),
        F.sum(size * F.pow(center - F.col("_grand"), 2)).alias("ss_between"),
        F.sum(spread).alias("ss_within"),
        (F.max(center) - F.min(center)).alias("diff_mean"),
        F.min(size).alias("_min_n"),
        F.min(F.coalesce(F.col(var), F.lit(0.0))).alias("_min_var"),
    )
    status = (
        F.when(F.col("n_groups") < 2, "single_group")
        .when(F.col("_min_n") < min_n, "small_group")
        .when(F.col("_min_var") < 0, "negative_variance")
        .when(F.col("n_total") <= F.col("n_groups"), "no_residual")
        .when((F.col("ss_within") == 0) & (F.col("diff_mean") == 0), "no_variance")
        .otherwise("ok")
    )
    valid = F.col("status") == "ok"
    table = table.withColumn("status", status).withColumns(
        {
            "df_between": F.when(valid, F.col("n_groups") - 1),
            "df_within": F.when(valid, F.col("n_total") - F.col("n_groups")),
        }
    )
    table = table.withColumns(
        {
            "ms_between": ratio(F.col("ss_between"), F.col("df_between")),
            "ms_within": ratio(F.col("ss_within"), F.col("df_within")),
        }
    )
    # Unequal groups without any spread differ for certain.
    certain = valid & (F.col("ss_within") == 0)
    statistic = F.when(certain, F.lit(float("inf"))).otherwise(ratio(F.col("ms_between"), F.col("ms_within")))
    return table.withColumn("F", statistic).select(
        *by, "n_groups", "n_total", "ss_between", "ss_within", "df_between", "df_within", "ms_between",
        "ms_within", "F", "diff_mean", "status",
    )


def anova(df: DataFrame, by: Sequence[str], group: str, outcome: str) -> DataFrame:
    """One-way ANOVA of the outcome over groups, and the spread of the group means. Rows without an
    outcome (null or NaN) are left out."""
    groups = group_means(df.filter(clean(F.col(outcome).cast("double")).isNotNull()), by, group, outcome)
    return anova_from_stats(groups, by)


def with_f_tail(table: DataFrame) -> DataFrame:
    return table.withColumn("p_value", f_tail(F.col("F"), F.col("df_between"), F.col("df_within")))


def significant(
    table: DataFrame, alpha: float = ALPHA_GROUPS, p: str = "p_value", effect: str = "diff_mean",
    null_insignificant: bool = True, into: str = "diff",
) -> DataFrame:
    """Flag at level alpha; the effect size of an insignificant row may be nulled."""
    flagged = table.withColumn(into, F.coalesce(F.col(p) < alpha, F.lit(False)))
    if not null_insignificant:
        return flagged
    return flagged.withColumn(effect, F.when(F.col(into), F.col(effect)))


def chi2_one_vs_rest(
    df: DataFrame, by: Sequence[str], topic: str, group: str, count: str | None = None
) -> DataFrame:
    """Per analysis and topic: is the topic spread over the groups like all other topics are?

    The 2×k table is summed from the cells that occur. A group in which the topic is absent
    contributes R·G/(N−R) to the statistic, so no grid of empty cells is built. With two groups
    each deviation is reduced by up to one half (Yates).
    """
    by = list(by)
    weight = F.lit(1) if count is None else F.col(count)
    cells = (
        df.filter(F.col(topic).isNotNull() & F.col(group).isNotNull())
        .groupBy(*by, topic, group)
        .agg(F.sum(weight).cast("double").alias("_o"))
    )
    of_group = cells.groupBy(*by, group).agg(F.sum("_o").alias("_g"))
    analysis = Window.partitionBy(*by)
    of_group = of_group.withColumn("_n", F.sum("_g").over(analysis)).withColumn(
        "_k", F.count(F.lit(1)).over(analysis)
    )
    joined = null_safe_join(cells, of_group, [*by, group]).withColumn(
        "_r", F.sum("_o").over(Window.partitionBy(*by, topic))
    )
    o, g, r, n, k = (F.col(c) for c in ("_o", "_g", "_r", "_n", "_k"))
    expected = r * g / n
    rest = g - expected
    off = F.abs(o - expected)
    off = off - F.when(k == 2, F.least(off, F.lit(0.5))).otherwise(F.lit(0.0))
    cell = ratio(off * off, expected) + ratio(off * off, rest)
    table = joined.groupBy(*by, topic).agg(
        F.first("_k").alias("_k"),
        F.first("_n").alias("_n"),
        F.first("_r").alias("_r"),
        F.sum("_g").alias("_seen"),
        F.count(F.lit(1)).alias("_present"),
        F.sum(cell).alias("_present_sum"),
        F.min(expected).alias("_e"),
    )
    absent = F.col("_n") - F.col("_seen")
    # With two groups and one absent, its deviation equals that of the other group: E, less Yates.
    missing_e = r * absent / n
    missing_off = missing_e - F.least(missing_e, F.lit(0.5))
    missing_two = ratio(missing_off * missing_off, missing_e) + ratio(
        missing_off * missing_off, absent - missing_e
    )
    missing = F.when(F.col("_present") == k, 0.0).otherwise(
        F.when(k == 2, missing_two).otherwise(ratio(r * absent, n - r))
    )
    status = (
        F.when(k < 2, "single_group")
        .when(F.col("_n") == F.col("_r"), "single_topic")
        .otherwise("ok")
    )
    return table.select(
        *by,
        topic,
        F.col("_r").cast("bigint").alias("n"),
        F.when(status == "ok", F.col("_present_sum") + missing).alias("statistic"),
        (k - 1).alias("df"),
        status.alias("status"),
    )


def with_chi2_tail(table: DataFrame) -> DataFrame:
    return table.withColumn("p_value", chi2_tail(F.col("statistic"), F.col("df")))


def ttest_columns(mean1, sd1, n1, mean2, sd2, n2) -> dict[str, Column]:
    """Equal-variance t statistic and degrees of freedom from two summaries."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    df = n1 + n2 - 2
    pooled = ratio((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2, df)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return {"t": ratio(mean1 - mean2, error), "df": df}


# The compared cells of the 2×2 table.
CONTRAST_PAIRS = [
    ("same_group_same_topic", "same_group_diff_topic"),
    ("same_group_same_topic", "diff_group_same_topic"),
    ("same_group_diff_topic", "diff_group_diff_topic"),
    ("diff_group_same_topic", "diff_group_diff_topic"),
]


def ttest_from_stats(
    cells: DataFrame, by: Sequence[str] = (), pairs=CONTRAST_PAIRS, cell: str = "cell",
    mean: str = "mean", sd: str = "sd", n: str = "n",
) -> DataFrame:
    """t-tests between named rows of a summary table, per analysis."""
    contrasts = F.array(
        *[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs]
    )
    summary = F.struct(F.col(mean).alias("mean"), F.col(sd).alias("sd"), F.col(n).alias("n"))
    packed = cells.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(cell), summary))).alias("_cells")
    )
    sides = packed.select(*by, "_cells", F.inline(contrasts)).select(
        *by,
        "first",
        "second",
        F.try_element_at("_cells", F.col("first")).alias("_a"),
        F.try_element_at("_cells", F.col("second")).alias("_b"),
    )
    a, b = F.col("_a"), F.col("_b")
    tested = ttest_columns(a["mean"], a["sd"], a["n"], b["mean"], b["sd"], b["n"])
    return sides.select(*by, "first", "second", *[c.alias(name) for name, c in tested.items()])


def with_t_tail(table: DataFrame) -> DataFrame:
    return table.withColumn("p_value", t_tail(F.col("t"), F.col("df")))
