"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from turnwise.catalog import QUERIES
from turnwise.session import build_session

HEADLINE = [
    "e2_disparity",
    "e2_overview",
    "e3_topic_association",
    "e3_pair_tests",
    "st1_anova",
    "st4_chi2_one_vs_rest",
    "st6_pair_table",
    "jn1_attach_survey",
    "jn4_outcome_with_features",
    "jn5_cross_prompts",
    "jn10_label_by_key",
    "rsh2_unpivot_aligned",
    "rsh3_crosstab",
    "rsh5_unpivot_demographics",
    "agg1_conversation_means",
    "agg2_chosen_first",
    "agg7_grouping_sets",
    "agg11_moments",
    "agg12_outcome_per_conversation",
    "agg17_confusion_matrix",
    "win1_collapse_same_type",
    "win2_until_first_missing",
    "win3_balance",
    "win5_folds_in_order",
    "arr2_typed_messages",
    "arr5_conversation_text",
    "str3_score_amount",
    "txt3_distinct_tokens",
    "txt7_reading_ease",
    "txt8_concreteness",
    "txt9_category_rates",
    "ml2_ols",
    "ml3_elastic_net_cv",
    "ml7_gram",
    "ml8_probe",
    "st10_almost_stochastic_order",
]


def run(df) -> None:
    """Compute every column of every row without bringing the rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["st1_anova"](spark, folder))
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(QUERIES[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
