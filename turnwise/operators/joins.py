"""Joins of the analysis. Strategies are left to the sizes Spark sees, unless noted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.sampling import hash_mod
from turnwise.operators.contained import SHARD_CHARS, contains_any

BANK_ROWS = 1000


def attach_survey(facts: DataFrame, survey: DataFrame, key: str = "user_id") -> DataFrame:
    return facts.join(survey, key, "inner")


def attach_topics(
    facts: DataFrame, topic_of: DataFrame, topic_names: DataFrame, conversation: str = "conversation_id"
) -> DataFrame:
    """Topic of the conversation; conversations without one are dropped."""
    named = topic_of.join(topic_names, "cluster_id").select(
        F.col("id").alias(conversation), F.col("gpt_description").alias("topic")
    )
    return facts.join(named, conversation, "inner")


def topic_from_prompt(df: DataFrame, flag: Column, prompt: Column) -> DataFrame:
    """The first prompt is the topic where it was given, else there is none."""
    return df.withColumn("topic", F.when(flag, prompt))


def pending_questions(questions: DataFrame, answers: DataFrame, keys: Sequence[str] = ("q_id",)) -> DataFrame:
    """Questions that no stored answer refers to. Distinct ids are taken first, so the anti-join
    moves one row per answered question, not the answers."""
    done = answers.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_done_{k}"))
    return questions.join(done, same, "left_anti")


def bounded_rows(df: DataFrame, columns: Sequence[str], limit: int) -> list | None:
    """The rows, or None where there are more than ``limit``."""
    rows = df.select(*columns).limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def cross_prompts(
    conversations: DataFrame, questions: DataFrame, conversation: str = "conversation_id",
    limit: int = BANK_ROWS, salts: int = 64,
) -> DataFrame:
    """Every question put to every conversation.

    The pairing is the result, so nothing smaller can be shuffled. A bank of checked size is
    exploded inside each conversation row: no shuffle at all. A larger bank is cut into pages that
    hold up to ``limit`` questions and joined on (page, salt).
    """
    fields = questions.schema.fields
    bank = bounded_rows(questions, questions.columns, limit)
    if bank is None:
        return _paged_prompts(conversations, questions, conversation, limit, salts)
    listed = F.array(
        *[
            F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields])
            for row in bank
        ]
    )
    if not bank:
        empty = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in fields)
        listed = F.array().cast(f"array<struct<{empty}>>")
    return conversations.select("*", F.inline(listed))


def _paged_prompts(
    conversations: DataFrame, questions: DataFrame, conversation: str, limit: int, salts: int
) -> DataFrame:
    fields = questions.columns
    pages = -(-2 * questions.count() // limit)
    paged = (
        questions.withColumn("_page", hash_mod(F.to_json(F.struct(*fields)), 0, pages))
        .groupBy("_page")
        .agg(F.collect_list(F.struct(*fields)).alias("_questions"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    spread = conversations.withColumn("_salt", hash_mod(F.col(conversation), 1, salts)).withColumn(
        "_page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))
    )
    return spread.join(paged, ["_page", "_salt"]).select(
        *conversations.columns, F.inline("_questions")
    )


def label_by_key(
    questions: DataFrame, keys: DataFrame, key: str = "key", question: str = "question",
    into: str = "correct_answer", shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """``yes`` where any key string occurs in the question, else ``no``."""
    marked = contains_any(questions, question, keys.select(key), "_holds_key", shard_chars)
    return marked.withColumn(into, F.when(F.col("_holds_key"), "yes").otherwise("no")).drop("_holds_key")
