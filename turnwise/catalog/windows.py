"""Turn order, samples and folds, ranks and top rows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.aggregates import COEFFICIENTS, IMPORTANCE, coefficients_view
from turnwise.catalog.registry import OUTCOMES, query, rounded, sql_hash_mod
from turnwise.functions.answers import fix_typos
from turnwise.operators.filters import differs
from turnwise.operators.importance import family_importance, families_of, top3_marks
from turnwise.operators.ranking import (
    assign_fold,
    balance,
    hold_out,
    rank_by_magnitude,
    sample_n,
    top_n,
    top_per_group,
)
from turnwise.operators.turns import collapse_same_role, until_first_missing
from turnwise.plans.disparity import compare_conditions

WITH_OUT = f"WITH {OUTCOMES} "


@query(
    "win1_collapse_same_role",
    """SELECT conv_id AS conversation_id, turn, role FROM (
      SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before
      FROM conversations WHERE role <> 'assistant' OR turn % 4 = 1)
    WHERE before IS DISTINCT FROM role""",
)
def _(t):
    runs = t.turns.filter((F.col("role") != "assistant") | (F.col("turn") % 4 == 1))
    return collapse_same_role(runs).select("conversation_id", "turn", "role")


@query(
    "win1_collapse_same_type",
    """SELECT user_id, event_id, event_type FROM (
      SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    WHERE before IS DISTINCT FROM event_type""",
)
def _(t):
    rows = t.events.select("user_id", "event_id", "event_type")
    return collapse_same_role(rows, "user_id", "event_id", "event_type")


@query(
    "win2_until_first_missing",
    """SELECT user_id, event_id FROM (
      SELECT *, bool_and(value > 1.0) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS still FROM events)
    WHERE still""",
)
def _(t):
    rows = t.events.select("user_id", "event_id", "value")
    kept = until_first_missing(rows, F.col("value") > 1.0, "user_id", "event_id")
    return kept.select("user_id", "event_id")


@query(
    "win3_balance",
    WITH_OUT
    + """, sized AS (SELECT *, md5(concat_ws('#', CAST(conversation_id AS VARCHAR), '7')) AS h FROM out)
    SELECT conversation_id, status FROM (
      SELECT *, row_number() OVER (PARTITION BY status ORDER BY h, conversation_id) AS r FROM sized)
    WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM out GROUP BY status))""",
)
def _(t):
    return balance(t.outcomes.select("conversation_id", "status"), "status", "conversation_id", 7)


@query(
    "win4_sample_per_stratum",
    """SELECT doc_id, lang FROM (
      SELECT *, row_number() OVER (PARTITION BY lang
        ORDER BY md5(concat_ws('#', CAST(doc_id AS VARCHAR), '42')), doc_id) AS r FROM documents)
    WHERE r <= 50""",
)
def _(t):
    return sample_n(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", 50, 42)


@query(
    "win5_folds_by_hash",
    f"""SELECT o_orderkey, CAST({sql_hash_mod('o_orderkey', 42, 5)} AS INT) AS fold,
      {sql_hash_mod("CAST(o_orderkey AS VARCHAR) || '/3'", 0, 1000000)} < 250000 AS held_out
    FROM orders""",
)
def _(t):
    folds = assign_fold(t.orders.select("o_orderkey"), "o_orderkey", 5, 42)
    return folds.withColumn("held_out", hold_out("o_orderkey", 3))


@query(
    "win5_folds_in_order",
    """SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INT) AS fold FROM orders""",
)
def _(t):
    return assign_fold(t.orders.select("o_orderkey"), "o_orderkey", 7, shuffle=False)


@query(
    "win5_folds_in_order_of_names",
    """WITH named AS (SELECT CASE WHEN o_orderkey > 1 THEN reverse(CAST(o_orderkey AS VARCHAR)) || '-' || o_orderkey END AS name FROM orders)
    SELECT name, CAST(ntile(11) OVER (ORDER BY name NULLS FIRST) - 1 AS INT) AS fold FROM named""",
)
def _(t):
    key = F.col("o_orderkey")
    name = F.when(key > 1, F.concat_ws("-", F.reverse(key.cast("string")), key.cast("string")))
    return assign_fold(t.orders.select(name.alias("name")), "name", 11, shuffle=False)


@query(
    "win6_rank_by_magnitude",
    f"""WITH {COEFFICIENTS} SELECT analysis, feature, round(coefficient, 6) AS coefficient,
      CAST(row_number() OVER (PARTITION BY analysis ORDER BY abs(coefficient) DESC, feature) AS INT) AS rank
    FROM coefficients""",
)
def _(t):
    ranked = rank_by_magnitude(coefficients_view(t), ["analysis"], "coefficient", "feature")
    return ranked.select("analysis", "feature", *rounded("coefficient"), "rank")


@query(
    "srt1_sorted_aggregate",
    "SELECT lang, round(avg(n_chars), 4) AS mean FROM documents GROUP BY 1 ORDER BY 2",
)
def _(t):
    return t.documents.groupBy("lang").agg(F.round(F.avg("n_chars"), 4).alias("mean")).orderBy("mean")


@query(
    "srt2_top_features",
    f"""WITH {COEFFICIENTS} SELECT analysis, feature, round(coefficient, 6) AS coefficient, rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY analysis ORDER BY abs(coefficients.coefficient) DESC, feature) AS INT) AS rank
      FROM coefficients) WHERE rank <= 20""",
)
def _(t):
    order = [F.abs("coefficient").desc(), F.col("feature")]
    best = top_per_group(coefficients_view(t), ["analysis"], 20, order, F.col("feature"))
    return best.select("analysis", "feature", *rounded("coefficient"), "rank")


@query(
    "srt2_top_features_of_all",
    f"""WITH {COEFFICIENTS} SELECT analysis, feature, round(coefficient, 6) AS coefficient FROM coefficients
    ORDER BY abs(coefficients.coefficient) DESC, feature, analysis LIMIT 20""",
)
def _(t):
    best = top_n(coefficients_view(t), 20, [F.abs("coefficient").desc(), F.col("feature"), F.col("analysis")])
    return best.select("analysis", "feature", *rounded("coefficient"))


@query(
    "srt3_top3_marks",
    IMPORTANCE
    + """, long AS (
      SELECT analysis, family, 'max' AS measure, max_importance AS value FROM importance
      UNION ALL SELECT analysis, family, 'mean', round(mean_importance, 2) FROM importance)
    SELECT analysis, family, measure, round(value, 6) AS value, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY analysis, measure ORDER BY value DESC, family) AS rank
      FROM long) WHERE rank <= 3""",
)
def _(t):
    marks = top3_marks(family_importance(coefficients_view(t), ["analysis"], ["age"]), ["analysis"])
    return marks.select("analysis", "family", "measure", *rounded("value"), "rank")


@query("srt4_first_rows", "SELECT * FROM conversations ORDER BY conv_id, turn, role, text LIMIT 5")
def _(t):
    return t.conversations.orderBy("conv_id", "turn", "role", "text").limit(5)


@query(
    "set1_append_domains",
    """SELECT item_id AS id, 'legal' AS domain, replace(text, 'th', 'TH') AS question FROM benchmark
    UNION ALL SELECT conv_id * 100 + turn, 'medical', replace(text, 'th', 'TH') FROM conversations""",
)
def _(t):
    legal = t.benchmark.select(
        F.col("item_id").alias("id"), F.lit("legal").alias("domain"), F.col("text").alias("question")
    )
    medical = t.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.lit("medical").alias("domain"),
        F.col("text").alias("question"),
    )
    both = legal.unionByName(medical)
    return both.withColumn("question", fix_typos(F.col("question"), {"th": "TH"}))


@query(
    "set2_compare_conditions",
    WITH_OUT
    + """, m AS (SELECT segment, status AS condition, avg(outcome) AS mean, count(*) AS n FROM out GROUP BY 1, 2)
    SELECT a.segment, round(a.mean, 4) AS mean_before, round(b.mean, 4) AS mean_after,
      round(b.mean - a.mean, 4) AS mean_change, a.n AS n_before, b.n AS n_after, b.n - a.n AS n_change
    FROM m a JOIN m b ON a.segment = b.segment AND a.condition = 'F' AND b.condition = 'O'""",
)
def _(t):
    rows = t.outcomes.groupBy("segment", F.col("status").alias("condition")).agg(
        F.avg("outcome").alias("mean"), F.count(F.lit(1)).alias("n")
    )
    both = compare_conditions(rows, ["segment"], "F", "O", ["mean", "n"])
    return both.select(
        "segment", *rounded("mean_before", "mean_after", "mean_change", digits=4),
        "n_before", "n_after", "n_change",
    )


@query(
    "set3_remaining_family",
    f"""WITH {COEFFICIENTS} SELECT analysis, feature FROM coefficients EXCEPT
    SELECT analysis, feature FROM coefficients
    WHERE contains(feature, 'age') OR contains(feature, 'dummy_topic') OR starts_with(feature, 'e_')
      OR starts_with(feature, 's_') OR contains(feature, '_liwc_') OR starts_with(feature, 'flesch')""",
)
def _(t):
    members = coefficients_view(t).withColumn(
        "family", F.explode(families_of(F.col("feature"), ["age"]))
    )
    return members.filter(~differs(F.col("family"), "linguistic")).select("analysis", "feature")
