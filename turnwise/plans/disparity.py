"""From answers to outcomes, and from outcomes to differences between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.config import ALPHA_GROUPS, AMOUNT_DOMAIN, DEMOGRAPHIC_ALIASES, UNKNOWN_MARKERS
from turnwise.functions.answers import score_amount, score_yes_no
from turnwise.operators.aggregates import (
    grouping_sets,
    null_safe_join,
    outcome_per_conversation,
)
from turnwise.operators.filters import known, recode
from turnwise.operators.reshape import unpivot_demographics
from turnwise.operators.tests_of_difference import anova, significant, with_f_tail


BANK_KEYS = ["model", "condition", "q_id"]


def scored_answers(answers: DataFrame, questions: DataFrame, trim: bool = False) -> DataFrame:
    """Answers with their domain and score: 0/1 against the key, or the first amount.

    A bank, its question ids and its key belong to one model and condition, so both count as far as
    the two tables have them. A key that the bank holds twice is an error.
    """
    keys = [k for k in BANK_KEYS if k in questions.columns and k in answers.columns]
    bank = questions.groupBy(*keys).agg(
        F.first("domain").alias("domain"), F.first("correct_answer").alias("correct_answer"), F.count("*").alias("_n")
    )
    twice = F.raise_error(F.concat(F.lit("question listed twice: "), F.to_json(F.struct(*keys))))
    bank = bank.select(*keys, F.when(F.col("_n") > 1, twice).otherwise(F.col("domain")).alias("domain"), "correct_answer")
    keyed = null_safe_join(answers, bank, keys)
    score = F.when(
        F.col("domain") == AMOUNT_DOMAIN, score_amount(F.col("answer"))
    ).otherwise(score_yes_no(F.col("answer"), F.col("correct_answer"), trim))
    return keyed.withColumn("score", score.cast("double"))


def outcomes(answers: DataFrame, questions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One outcome per (keys, domain): percent of favourable answers, or the mean amount."""
    scored = scored_answers(answers, questions)
    return outcome_per_conversation(
        scored, [*keys, "domain"], "score", F.col("domain") != AMOUNT_DOMAIN
    )


def baselines(questions: DataFrame, keys: Sequence[str] = ("model",), excluded: Sequence[str] = ()) -> DataFrame:
    """The same outcome for the answers given without any conversation."""
    asked = questions.filter(~F.col("q_id").isin(*excluded)) if excluded else questions
    score = F.when(
        F.col("domain") == AMOUNT_DOMAIN, score_amount(F.col("baseline_answer"))
    ).otherwise(score_yes_no(F.col("baseline_answer"), F.lower("correct_answer")))
    scored = asked.withColumn("_score", score.cast("double"))
    return outcome_per_conversation(
        scored, [*keys, "domain"], "_score", F.col("domain") != AMOUNT_DOMAIN
    ).withColumnRenamed("outcome", "baseline")


def disparity(
    outcome_rows: DataFrame, by: Sequence[str], demographics: Sequence[str],
    markers: Sequence[str] = UNKNOWN_MARKERS,
) -> DataFrame:
    """ANOVA and spread of the outcome for every analysis and demographic in one job."""
    long = unpivot_demographics(outcome_rows, [*by, "outcome"], demographics)
    return anova(known(long, "group", markers), [*by, "demo"], "group", "outcome")


def overview(table: DataFrame, alpha: float = ALPHA_GROUPS, null_insignificant: bool = True) -> DataFrame:
    """Flagged result rows, with the demographic names both datasets share."""
    flagged = significant(with_f_tail(table), alpha, null_insignificant=null_insignificant)
    return flagged.withColumn("demo", recode(F.col("demo"), DEMOGRAPHIC_ALIASES))


def overview_summary(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Significant share and count, effect sizes and F per grouping, all groupings in one pass."""
    flag = F.col("diff").cast("int")
    return grouping_sets(
        rows,
        sets,
        [
            F.count("diff").alias("n"),
            F.sum(flag).alias("n_diff"),
            F.avg(flag).alias("share_diff"),
            F.avg("diff_mean").alias("mean_effect"),
            F.max("diff_mean").alias("max_effect"),
            F.sum("F").alias("sum_f"),
        ],
    )


def compare_conditions(rows: DataFrame, by: Sequence[str], before: str, after: str, measures: Sequence[str]) -> DataFrame:
    """Measures of two conditions side by side, and their change."""
    wide = rows.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("condition") == condition, F.col(m))).alias(f"{m}_{name}")
            for m in measures
            for name, condition in (("before", before), ("after", after))
        ]
    )
    return wide.withColumns(
        {f"{m}_change": F.col(f"{m}_after") - F.col(f"{m}_before") for m in measures}
    )
