"""Label inference requests: one JSON object per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.config import INFERENCE_PROMPT
from turnwise.functions.answers import fill_prompt


def build_requests(
    conversations: DataFrame, model: str, key: str = "conversation_id", text: str = "conversation_text",
    template: str = INFERENCE_PROMPT,
) -> DataFrame:
    """(custom_id, body). The id carries the business key, so responses join back without positions."""
    message = F.struct(
        F.lit("user").alias("role"), fill_prompt(template, F.col(text)).alias("content")
    )
    return conversations.select(
        F.concat(F.lit("request-"), F.col(key).cast("string")).alias("custom_id"),
        F.struct(
            F.lit(model).alias("model"),
            F.array(message).alias("messages"),
            F.struct(F.lit(False).alias("enabled")).alias("reasoning"),
        ).alias("body"),
    )


def write_requests(requests: DataFrame, path: str, mode: str = "errorifexists") -> None:
    requests.write.mode(mode).json(path)


def request_key(custom_id: Column) -> Column:
    """``request-17`` → ``17``."""
    return F.substring_index(custom_id, "request-", -1)
