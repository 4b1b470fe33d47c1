"""Demographics inferred from conversations: labels read from responses, compared with the survey."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.config import (
    ASO_THRESHOLD,
    PREDICTION_KEYS,
    PREDICTION_LABELS,
    PREDICTION_MARKERS,
    PREDICTION_RECODES,
)
from turnwise.functions.answers import predicted_label
from turnwise.operators.aggregates import null_safe_join
from turnwise.operators.classification import (
    confusion_counts,
    majority_baseline,
    random_baseline,
    summary_scores,
)
from turnwise.operators.dominance import aso
from turnwise.operators.filters import recode
from turnwise.session import stored
from turnwise.sources.requests import request_key


def inferred_labels(
    responses: DataFrame, people: DataFrame, key: str = "conversation_id",
    labels: Mapping[str, Sequence[str]] = PREDICTION_LABELS,
    json_keys: Mapping[str, str] = PREDICTION_KEYS,
    recodes: Mapping[str, Mapping[str, str]] = PREDICTION_RECODES,
    markers: Sequence[str] = PREDICTION_MARKERS,
) -> DataFrame:
    """(key, demo, true, predicted) for every demographic with a known value and a named label."""
    named = responses.select(
        request_key(F.col("custom_id")).alias(key),
        *[predicted_label(F.col("content"), json_keys[d], labels[d]).alias(f"_{d}") for d in labels],
    )
    known_people = people.select(
        F.col(key).cast("string").alias(key),
        *[recode(F.col(d), recodes.get(d, {})).alias(d) for d in labels],
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(d).alias("demo"), F.col(d).alias("true"), F.col(f"_{d}").alias("predicted")
            )
            for d in labels
        ]
    )
    long = known_people.join(named, key).select(key, F.inline(pairs))
    return long.filter(
        F.col("true").isNotNull() & ~F.col("true").isin(*markers) & F.col("predicted").isNotNull()
    )


def inference_scores(
    rows: DataFrame, key: str = "conversation_id", seed: int = 42, threshold: float = ASO_THRESHOLD
) -> DataFrame:
    """Micro F1 of the inference and of both baselines per demographic, and whether its hits are
    almost stochastically more frequent than theirs.

    The rows are written once. Rows that agree in all four labels are then counted, and every score comes
    from these counts.
    """
    by = ["demo"]
    keyed = stored(rows.select(key, *by, "true", "predicted"), "inferred")
    keyed = keyed.withColumn("_draw", F.concat_ws("/", key, "demo"))
    based = random_baseline(majority_baseline(keyed, by, "true"), by, "true", "_draw", seed)
    sources = {"f1": "predicted", "majority_f1": "majority", "random_f1": "random"}
    cells = based.groupBy(*by, "true", *sources.values()).agg(F.count(F.lit(1)).alias("_n"))
    cells = stored(cells, "label_cells")
    long = cells.unpivot([*by, "true", "_n"], list(sources.values()), "_source", "_label")
    micro = summary_scores(
        confusion_counts(long, [*by, "_source"], "true", "_label", "_n"), [*by, "_source"]
    )
    result = micro.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("_source") == source, F.col("micro_f1"))).alias(name)
            for name, source in sources.items()
        ]
    )
    hits = cells.select(
        *by, "_n", *[(F.col(s) == F.col("true")).cast("int").alias(f"_{s}") for s in sources.values()]
    )
    for baseline in ("majority", "random"):
        scored = aso(hits, by, "_predicted", f"_{baseline}", seed, weight="_n").select(
            *by,
            F.col("aso").alias(f"{baseline}_aso"),
            (F.col("aso") < threshold).alias(f"{baseline}_better"),
        )
        result = null_safe_join(result, scored, by)
    return result
