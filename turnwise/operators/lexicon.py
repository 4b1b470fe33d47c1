"""Lexicon features: rates of the words of a lexicon in each text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.numeric import ratio
from turnwise.functions.text import tokens, words


def _token_rows(df: DataFrame, keys: Sequence[str], found: Column) -> DataFrame:
    """One row per token. Joined to a lexicon small enough to broadcast, these rows stay in their
    task and are summed per text before anything is shuffled; a larger lexicon is an ordinary
    shuffled join, in which frequent words are split as skewed partitions."""
    return df.select(*keys, found.alias("_found")).select(
        *keys, F.size("_found").alias("_total"), F.explode_outer("_found").alias("word")
    )


def concreteness(
    df: DataFrame, keys: Sequence[str], side: str, lexicon: DataFrame, eligible: Column | None = None
) -> DataFrame:
    """Sum of the ratings of matched words over the number of all words (exact-case match).

    Null for a text without words or in a language without ratings.
    """
    found = words(tokens(F.col(side)))
    if eligible is not None:
        found = F.when(eligible, found)
    # A word that is listed twice has its highest rating.
    rated = lexicon.filter(F.col("weight").isNotNull()).groupBy("word").agg(F.max("weight").alias("weight"))
    joined = _token_rows(df, keys, found).join(rated, "word", "left")
    total = F.first("_total")
    return joined.groupBy(*keys).agg(
        ratio(
            F.coalesce(F.sum("weight"), F.lit(0.0)),
            F.when(total > 0, total),
        ).alias(f"avg_concreteness_{side}")
    )


def category_rates_long(df: DataFrame, keys: Sequence[str], side: str, lexicon: DataFrame) -> DataFrame:
    """(keys, category, rate) for the categories that occur: share of tokens, ×100 not applied."""
    listed = lexicon.select("word", "category").distinct()
    joined = _token_rows(df, keys, tokens(F.col(side))).join(listed, "word")
    return joined.groupBy(*keys, "category").agg(
        ratio(F.count(F.lit(1)), F.first("_total")).alias("rate")
    )


def category_rates(
    df: DataFrame, keys: Sequence[str], side: str, lexicon: DataFrame, categories: Sequence[str]
) -> DataFrame:
    """One ``<side>_liwc_<category>`` column per category, 0 where no word of it occurs."""
    listed = lexicon.select("word", "category").distinct()
    joined = _token_rows(df, keys, tokens(F.col(side))).join(listed, "word", "left")
    total = F.first("_total")
    return joined.groupBy(*keys).agg(
        *[
            ratio(
                F.count(F.when(F.col("category") == c, 1)),
                F.when(total > 0, total),
            ).alias(f"{side}_liwc_{c}")
            for c in categories
        ]
    )
