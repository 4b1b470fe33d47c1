"""From source tables to conversations, utterances and features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.config import POLITENESS, RESPONSE_LETTERS, TURNS, UNUSED_FEATURES
from turnwise.functions import turns as nested
from turnwise.functions.structs import pick_by_label, simplify_survey
from turnwise.functions.text import text_features
from turnwise.operators.aggregates import conversation_means
from turnwise.operators.filters import recode
from turnwise.operators.joins import attach_survey
from turnwise.operators.turns import chosen_first, unpivot_aligned

SIDES = ["user_prompt", "model_response"]


def survey_conversations(conversations: DataFrame, survey: DataFrame, typed: bool = False) -> DataFrame:
    """Nested conversations with flat demographics and their chat messages."""
    joined = simplify_survey(attach_survey(conversations, survey))
    history = nested.collapse_same_role(nested.select_turns(F.col("conversation_history")))
    return joined.withColumn("messages", nested.to_messages(history, typed))


def survey_utterances(utterances: DataFrame, survey: DataFrame, order: str = "utterance_order") -> DataFrame:
    """Chosen utterances, one per conversation and turn, with flat demographics."""
    keys = ["conversation_id", "turn"]
    joined = simplify_survey(attach_survey(utterances, survey)).drop("location")
    columns = [c for c in joined.columns if c not in [*keys, order, "if_chosen"]]
    return chosen_first(joined, keys, order, columns, F.col("if_chosen"))


def wide_conversations(wide: DataFrame, typed: bool = False) -> DataFrame:
    """Chat messages of the wide table, up to the first turn without a preferred response."""
    return wide.withColumn("messages", nested.turns_from_columns(TURNS, typed))


def wide_utterances(
    wide: DataFrame, ids: Sequence[str], language: str = "en", language_column: str = "assigned_lang"
) -> DataFrame:
    """One row per conversation and used turn: prompt, preferred response, feedback."""
    preferred = {
        f"_response_{t}": pick_by_label(
            F.col(f"{t}_turn_preferred_response"),
            {a: F.col(f"{t}_turn_response_{a}") for a in RESPONSE_LETTERS},
        )
        for t in TURNS
    }
    families = {
        t: {
            "user_prompt": f"{t}_turn_prompt",
            "model_response": f"_response_{t}",
            "feedback": f"{t}_turn_feedback",
        }
        for t in TURNS
    }
    rows = wide.filter(F.col(language_column) == language).withColumns(preferred)
    return unpivot_aligned(rows, ids, families, "turn", "user_prompt")


def utterance_features(
    utterances: DataFrame, stop_words: Mapping[str, Sequence[str]], language: Column | None = None
) -> DataFrame:
    """Text features of both sides; only columns that exist are read."""
    df = utterances
    for side in SIDES:
        if side in df.columns:
            df = text_features(df, side, stop_words, language)
    return df


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(s in c for s in SIDES) and c not in SIDES]


def features_per_conversation(
    features: DataFrame, demographics: Sequence[str], topic: str = "topic", conversation: str = "conversation_id"
) -> DataFrame:
    """Every feature averaged over the turns of a conversation; politeness labels as numbers."""
    df = features.drop(*UNUSED_FEATURES)
    for side in SIDES:
        name = f"politeness_{side}"
        if name in df.columns:
            df = df.withColumn(name, recode_politeness(F.col(name)))
    return conversation_means(df, [conversation, *demographics, topic], feature_columns(df))


def recode_politeness(label: Column) -> Column:
    return recode(label, {k: str(v) for k, v in POLITENESS.items()}).try_cast("double")
