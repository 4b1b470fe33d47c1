"""The slot for models: batched scoring of a text column by a scorer the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[pd.Series], pd.DataFrame]


def score_batch(
    df: DataFrame, column: str, load_scorer: Callable[[], Scorer], fields: str, keep: Sequence[str]
) -> DataFrame:
    """Append the scorer's columns to the kept ones.

    ``load_scorer`` runs once per task, the scorer once per Arrow batch
    (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows).
    """
    keep = list(keep)
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([df.schema[k] for k in keep] + added.fields)
    carried = [*keep, *([column] if column not in keep else [])]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load_scorer()
        for pdf in batches:
            scored = scorer(pdf[column]).reset_index(drop=True)
            yield pd.concat([pdf[keep].reset_index(drop=True), scored], axis=1)[schema.names]

    return df.select(*carried).mapInPandas(score, schema)


def scores_to_columns(df: DataFrame, scores: str, labels: Sequence[str], prefix: str, side: str) -> DataFrame:
    """A label→score map as ``<prefix><label>_<side>`` columns; an absent label is null."""
    return df.withColumns(
        {f"{prefix}{label}_{side}": F.try_element_at(scores, F.lit(label)) for label in labels}
    ).drop(scores)


def best_label(scores: Column) -> Column:
    """The label with the highest score; ties go to the smaller label."""
    entries = F.transform(F.map_entries(scores), lambda e: F.struct(-e["value"], e["key"].alias("key")))
    return F.array_min(entries)["key"]
