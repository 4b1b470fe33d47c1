"""Incremental work: answers that arrive question by question, and summaries that are updated.

There is no event time here. A run asks the pending questions, appends their answers as one
partition each, and can stop and resume anywhere; summaries are kept as sufficient statistics, to
which rows are added or from which they are removed without touching the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions.numeric import ratio
from turnwise.operators.aggregates import null_safe_join
from turnwise.operators.joins import pending_questions


#: What tells questions apart, as far as the tables have it.
QUESTION_KEYS = ("model", "dataset", "condition", "q_id")


def append_answers(answers: DataFrame, path: str) -> None:
    """Store answers by question. One call is one commit: after a failure none of its answers count."""
    answers.write.mode("append").partitionBy("q_id").parquet(path)


def stored_questions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Answers stored so far; an empty table where nothing is stored yet."""
    try:
        spark.read.schema(schema).parquet(path).schema
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def resume_answers(
    questions: DataFrame, path: str, schema: str, answer: Callable[[DataFrame], DataFrame],
    keys: Sequence[str] = QUESTION_KEYS, batches: int = 1,
) -> None:
    """Answer the questions that have no stored answer yet and append the result.

    A question is known by those ``keys`` that both tables have. The pending questions are committed in
    ``batches`` by a hash of their keys: a run that stops keeps the batches it has finished, and the
    next one asks what is left.
    """
    for batch in range(batches):
        done = stored_questions(questions.sparkSession, path, schema)
        shared = [k for k in keys if k in questions.columns and k in done.columns]
        of_batch = questions.filter(F.pmod(F.xxhash64(*shared), F.lit(batches)) == batch)
        append_answers(answer(pending_questions(of_batch, done, shared)), path)


def sufficient_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, m2) of the non-null values."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")
    )


def update_statistics(state: DataFrame, change: DataFrame, keys: Sequence[str], remove: bool = False) -> DataFrame:
    """The state after the rows behind ``change`` were added or removed."""
    renamed = change.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("n", "mean", "m2")])
    if remove:
        joined = null_safe_join(state, renamed, list(keys), "left")
    else:
        # One row for each key of either side, null keys among them.
        none = {c: F.lit(None).cast("double") for c in ("n", "mean", "m2")}
        sides = state.select(*keys, "n", "mean", "m2", *[none[c].alias(f"_{c}") for c in none]).unionByName(
            renamed.select(*keys, *[none[c].alias(c) for c in none], "_n", "_mean", "_m2")
        )
        joined = sides.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("n", "mean", "m2", "_n", "_mean", "_m2")])
    joined = joined.na.fill(0.0, ["n", "mean", "m2", "_n", "_mean", "_m2"])
    sign = F.lit(-1 if remove else 1)
    n = F.col("n") + sign * F.col("_n")
    gap = F.col("_mean") - F.col("mean")
    mean = ratio(F.col("n") * F.col("mean") + sign * F.col("_n") * F.col("_mean"), n)
    # Adding and removing share this term: gap is the distance to the mean of the present state.
    between = ratio(gap * gap * F.col("n") * F.col("_n"), n)
    m2 = F.col("m2") + sign * F.col("_m2") + sign * F.coalesce(between, F.lit(0.0))
    return joined.filter(n > 0).select(
        *keys, n.cast("bigint").alias("n"), mean.alias("mean"), F.greatest(m2, F.lit(0.0)).alias("m2")
    )


def variances(state: DataFrame) -> DataFrame:
    return state.withColumns(
        {
            "var_pop": ratio(F.col("m2"), F.col("n")),
            "var_samp": ratio(F.col("m2"), F.col("n") - 1),
        }
    )
