"""Readers. Every text format takes a schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise import schemas


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(
    spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A headed CSV file. ``multiline`` admits line breaks inside quoted fields, at the price of
    one task per file."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=multiline, escape='"')
    return df if columns is None else df.select(*columns)


def read_lexicon(
    spark: SparkSession, path: str, word: str = "Word", weight: str = "Conc.M", category: str = "concreteness"
) -> DataFrame:
    """A word-rating file as (word, category, weight). The join strategy is left to its size."""
    df = spark.read.csv(path, header=True, escape='"')
    return df.select(
        F.col(f"`{word}`").alias("word"),
        F.lit(category).alias("category"),
        F.col(f"`{weight}`").try_cast("double").alias("weight"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before heavy work per row, where a source has fewer splits than the
    cluster has cores. A large source has more, and is returned as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def response_content() -> Column:
    return F.get(F.col("response.body.choices"), F.lit(0))["message"]["content"]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Batch responses (JSON Lines) as (custom_id, content); only the first choice is read."""
    raw = spark.read.schema(schemas.RESPONSES).json(path)
    return raw.select("custom_id", response_content().alias("content"))
