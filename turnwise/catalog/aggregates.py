from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.registry import DEMOGRAPHICS, LONG, MARKERS, OUTCOMES, query, rounded
from turnwise.operators.aggregates import (
    class_summary,
    conversation_means,
    grouping_sets,
    group_spread,
    mean_ci,
    mean_ci_bootstrap,
    moments,
)
from turnwise.operators.classification import confusion_matrix
from turnwise.operators.filters import known
from turnwise.operators.importance import family_importance, importance_change, side_importance
from turnwise.operators.reshape import counts, unpivot_demographics
from turnwise.operators.turns import chosen_first
from turnwise.plans.disparity import baselines, outcomes, overview_summary
from turnwise.sources.tables import spread
from turnwise.streaming.incremental import sufficient_statistics, update_statistics, variances

WITH_OUT = f"WITH {OUTCOMES} "


@query(
    "agg1_conversation_means",
    """SELECT l_orderkey, l_returnflag, round(avg(l_quantity), 6) AS quantity,
      round(avg(l_tax), 8) AS tax FROM lineitem
    WHERE l_returnflag <> 'N' GROUP BY 1, 2""",
)
def _(t):
    nulled = t.lineitem.select(
        "l_orderkey",
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("l_returnflag"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_tax").alias("tax"),
    )
    means = conversation_means(nulled, ["l_orderkey", "l_returnflag"], ["quantity", "tax"])
    return means.select(
        "l_orderkey", "l_returnflag", *rounded("quantity"), *rounded("tax", digits=8)
    )


@query(
    "agg2_chosen_first",
    """SELECT user_id, event_type, arg_min(value, event_id) FILTER (WHERE value > 20) AS value,
      arg_min(props, event_id) AS props
    FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2""",
)
def _(t):
    nulled = t.events.withColumn("value", F.when(F.col("value") > 20, F.col("value")))
    return chosen_first(
        nulled, ["user_id", "event_type"], "event_id", ["value", "props"], F.col("event_id") % 3 != 0
    )


@query(
    "agg3_group_spread",
    f"""WITH {LONG} SELECT demo, round(max(m), 4) AS max_mean, round(min(m), 4) AS min_mean,
      round(max(m) - min(m), 4) AS diff_mean
    FROM (SELECT demo, grp, avg(outcome) AS m FROM long GROUP BY 1, 2) GROUP BY 1""",
)
def _(t):
    long = known(unpivot_demographics(t.outcomes, ["outcome"], DEMOGRAPHICS), "group", MARKERS)
    spread = group_spread(long, ["demo"], "group", "outcome")
    return spread.select("demo", *rounded("max_mean", "min_mean", "diff_mean", digits=4))


@query(
    "agg4_counts",
    WITH_OUT + "SELECT segment, topic, count(*) AS count FROM out GROUP BY 1, 2",
)
def _(t):
    return counts(t.outcomes, ["segment", "topic"])


# Result rows of a made-up study over the orders: every supplier nation of a part brand is an
# analysis, flagged where its mean quantity is above 25.5.
def _study(t):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("p_brand").alias("model"),
        F.col("l_returnflag").alias("dataset"),
        F.col("p_type").alias("domain"),
        F.col("l_linenumber").cast("string").alias("demo"),
    )
    rows = lines.agg(F.avg("l_quantity").alias("_q"), F.sum("l_quantity").alias("F"))
    flagged = rows.withColumn("diff", F.col("_q") > 25.5)
    return flagged.withColumn("diff_mean", F.when(F.col("diff"), F.col("_q"))).drop("_q")


STUDY = """study AS (
  SELECT model, dataset, domain, demo, q > 25.5 AS diff,
         CASE WHEN q > 25.5 THEN q END AS diff_mean, f AS "F"
  FROM (SELECT p_brand AS model, l_returnflag AS dataset, p_type AS domain,
               CAST(l_linenumber AS VARCHAR) AS demo, avg(l_quantity) AS q, sum(l_quantity) AS f
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4))"""


@query(
    "agg5_significant_share",
    f"""WITH {STUDY} SELECT model, count(*) AS n, CAST(sum(CAST(diff AS INT)) AS BIGINT) AS n_diff,
      round(avg(CAST(diff AS INT)), 6) AS share_diff FROM study GROUP BY 1""",
)
def _(t):
    rows = overview_summary(_study(t), [["model"]])
    return rows.select("model", "n", "n_diff", *rounded("share_diff"))


@query(
    "agg6_share_of_subset",
    f"""WITH {STUDY} SELECT dataset, round(avg(CAST(diff AS INT)), 6) AS share_diff FROM study
    WHERE demo IN ('1', '2', '3') GROUP BY 1""",
)
def _(t):
    rows = overview_summary(_study(t).filter(F.col("demo").isin("1", "2", "3")), [["dataset"]])
    return rows.select("dataset", *rounded("share_diff"))


_SETS = [["demo", "domain"], ["dataset", "domain"], ["dataset", "domain", "model"], ["domain", "model"]]


@query(
    "agg7_grouping_sets",
    f"""WITH {STUDY} SELECT demo, domain, dataset, model, count(*) AS n,
      round(avg(CAST(diff AS INT)), 6) AS share_diff, round(avg(diff_mean), 6) AS mean_effect
    FROM study GROUP BY GROUPING SETS
      ((demo, domain), (dataset, domain), (dataset, domain, model), (domain, model))""",
)
def _(t):
    rows = overview_summary(_study(t), _SETS)
    return rows.select(
        "demo", "domain", "dataset", "model", "n", *rounded("share_diff", "mean_effect")
    )


@query(
    "agg8_effect_size",
    f"""WITH {STUDY} SELECT domain, round(avg(diff_mean), 6) AS mean_effect,
      round(max(diff_mean), 6) AS max_effect FROM study GROUP BY 1""",
)
def _(t):
    rows = overview_summary(_study(t), [["domain"]])
    return rows.select("domain", *rounded("mean_effect", "max_effect"))


@query(
    "agg9_f_totals",
    f"""WITH {STUDY} SELECT domain, model, sum("F") AS sum_f, count("F") AS n FROM study GROUP BY 1, 2""",
)
def _(t):
    return grouping_sets(
        _study(t), [["domain", "model"]], [F.sum("F").alias("sum_f"), F.count("F").alias("n")]
    ).drop("grouping")


@query(
    "agg10_all_true",
    """SELECT l_linenumber, l_suppkey, bool_and(l_discount < 0.1) AND bool_and(l_tax < 0.08) AS better
    FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return t.lineitem.groupBy("l_linenumber", "l_suppkey").agg(
        (F.bool_and(F.col("l_discount") < 0.1) & F.bool_and(F.col("l_tax") < 0.08)).alias("better")
    )


@query(
    "agg11_moments",
    """SELECT l_suppkey, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean,
      round(var_pop(l_quantity), 6) AS var_pop, round(var_samp(l_quantity), 6) AS var_samp
    FROM lineitem GROUP BY 1""",
)
def _(t):
    rows = moments(t.lineitem, ["l_suppkey"], "l_quantity")
    return rows.select("l_suppkey", "n", *rounded("mean", "var_pop", "var_samp"))


@query(
    "agg11_moments_updated",
    """SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean,
      round(var_pop(l_quantity), 6) AS var_pop, round(var_samp(l_quantity), 6) AS var_samp
    FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1""",
)
def _(t):
    of = lambda *flags: sufficient_statistics(
        t.lineitem.filter(F.col("l_returnflag").isin(*flags)), ["l_suppkey"], "l_quantity"
    )
    state = update_statistics(of("A", "R"), of("N"), ["l_suppkey"])
    state = update_statistics(state, of("R"), ["l_suppkey"], remove=True)
    return variances(state).select("l_suppkey", "n", *rounded("mean", "var_pop", "var_samp"))


# Order lines read as answers: the return flag is the answer, the line number the question. Each model has
# a bank of its own, with other keys for the same question ids.
QUESTIONS = """questions AS (
  SELECT DISTINCT l_linestatus AS model, 'q_' || l_linenumber AS q_id,
    CASE WHEN l_linenumber = 7 THEN 'salary' WHEN l_linenumber > 3 THEN 'medical' ELSE 'legal' END AS domain,
    CASE (l_linenumber + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'n' ELSE 'r' END AS correct_answer
  FROM lineitem)"""
ANSWERS = """answers AS (
  SELECT l_linestatus AS model, l_orderkey AS conversation_id, 'q_' || l_linenumber AS q_id,
    l_linenumber AS line, l_returnflag, l_extendedprice FROM lineitem)"""


def questions_view(t):
    line = F.col("l_linenumber")
    shifted = (line + F.when(F.col("l_linestatus") == "O", 1).otherwise(0)) % 3
    return t.lineitem.select("l_linestatus", line).distinct().select(
        F.col("l_linestatus").alias("model"),
        F.concat(F.lit("q_"), line).alias("q_id"),
        F.when(line == 7, "salary").when(line > 3, "medical").otherwise("legal").alias("domain"),
        F.when(shifted == 0, "a").when(shifted == 1, "n").otherwise("r").alias("correct_answer"),
    )


def answers_view(t):
    amount = F.format_string("about $%s,%s a year", F.floor(F.col("l_extendedprice") / 1000), F.lit("000"))
    lines = t.lineitem.select(
        "l_linestatus", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"
    )
    return spread(lines).select(
        F.col("l_linestatus").alias("model"),
        F.col("l_orderkey").alias("conversation_id"),
        F.concat(F.lit("q_"), "l_linenumber").alias("q_id"),
        F.when(F.col("l_linenumber") == 7, amount).otherwise(F.col("l_returnflag")).alias("answer"),
    )


SCORED = f"""{QUESTIONS}, {ANSWERS}, scored AS (
  SELECT model, conversation_id, domain, CASE WHEN domain = 'salary'
    THEN floor(l_extendedprice / 1000) * 1000
    ELSE CAST(lower(l_returnflag) = correct_answer AS INT) END AS score
  FROM answers JOIN questions USING (model, q_id))"""

OUTCOME_ROWS = f"""{SCORED}, outcome_rows AS (
  SELECT model, conversation_id, domain,
    avg(score) * CASE WHEN domain = 'salary' THEN 1 ELSE 100 END AS outcome
  FROM scored GROUP BY 1, 2, 3)"""


@query(
    "agg12_outcome_per_conversation",
    f"""WITH {OUTCOME_ROWS} SELECT model, conversation_id, domain, round(outcome, 6) AS outcome
    FROM outcome_rows""",
)
def _(t):
    rows = outcomes(answers_view(t), questions_view(t), ["model", "conversation_id"])
    return rows.select("model", "conversation_id", "domain", *rounded("outcome"))


@query(
    "agg13_baselines",
    f"""WITH {SCORED} SELECT model, domain,
      round(avg(score) * CASE WHEN domain = 'salary' THEN 1 ELSE 100 END, 5) AS baseline
    FROM scored GROUP BY 1, 2""",
)
def _(t):
    asked = answers_view(t).withColumnRenamed("answer", "baseline_answer").join(questions_view(t), ["model", "q_id"])
    return baselines(asked).select("model", "domain", *rounded("baseline", digits=5))


@query(
    "agg14_mean_interval",
    WITH_OUT
    + """SELECT segment, count(*) AS n, round(avg(outcome), 4) AS mean,
      round(avg(outcome) - 1.96 * stddev_samp(outcome) / sqrt(count(*)), 4) AS low,
      round(avg(outcome) + 1.96 * stddev_samp(outcome) / sqrt(count(*)), 4) AS high
    FROM out GROUP BY 1""",
)
def _(t):
    rows = mean_ci(t.outcomes, ["segment"], "outcome")
    return rows.select("segment", "n", *rounded("mean", "low", "high", digits=4))


@query("agg14_mean_interval_bootstrap")
def _(t):
    return mean_ci_bootstrap(t.lineitem, ["l_returnflag"], "l_quantity", replicates=1000, seed=42)


@query(
    "agg15_class_summary",
    """WITH sizes AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
    SELECT source, min(n) AS min_size, count(*) AS n_classes,
      arg_min(lang, (-n, lang)) AS majority, max(n) AS majority_size, CAST(sum(n) AS BIGINT) AS n
    FROM sizes GROUP BY 1""",
)
def _(t):
    return class_summary(t.documents, ["source"], "lang")


@query("agg16_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(t):
    return t.documents.select("lang", "source").distinct()


@query(
    "agg17_confusion_matrix",
    """WITH c AS (SELECT quality AS a, toxic AS p FROM labels),
    l AS (SELECT a AS label FROM c UNION SELECT p FROM c),
    grid AS (SELECT x.label AS a, y.label AS p FROM l x, l y),
    n AS (SELECT g.a, g.p, count(c.a) AS n FROM grid g
          LEFT JOIN c ON c.a = g.a AND c.p = g.p GROUP BY 1, 2)
    SELECT a AS "true", p AS predicted, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS share FROM n""",
)
def _(t):
    rows = confusion_matrix(t.labels, [], "quality", "toxic")
    return rows.select("true", "predicted", "n", *rounded("share"))


# Coefficients: the slope of price on quantity within each part type and brand, named like the
# features of a fit; ``analysis`` is the return flag.
COEFFICIENTS = """coefficients AS (
  SELECT analysis, feature, regr_slope(l_extendedprice, l_quantity) / 1000 - 0.95 AS coefficient
  FROM (SELECT *, l_returnflag AS analysis, CASE
      WHEN p_size % 10 = 0 THEN 'dummy_topic_' || p_brand
      WHEN p_size % 10 = 1 THEN 'dummy_age_' || p_brand
      WHEN p_size % 10 = 2 THEN 'e_' || lower(p_type) || '_user_prompt'
      WHEN p_size % 10 = 3 THEN 's_' || lower(p_type) || '_model_response'
      WHEN p_size % 10 = 4 THEN 'user_prompt_liwc_' || p_brand
      WHEN p_size % 10 = 5 THEN 'model_response_liwc_' || p_brand
      WHEN p_size % 10 = 6 THEN 'flesch_reading_ease_user_prompt'
      WHEN p_size % 10 = 7 THEN 'dummy_topic_age ' || p_type
      ELSE 'num_' || lower(p_type) || '_model_response' END AS feature
    FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"""


def coefficients_view(t):
    kind, brand, type_ = F.col("p_size") % 10, F.col("p_brand"), F.lower("p_type")
    feature = (
        F.when(kind == 0, F.concat(F.lit("dummy_topic_"), brand))
        .when(kind == 1, F.concat(F.lit("dummy_age_"), brand))
        .when(kind == 2, F.concat(F.lit("e_"), type_, F.lit("_user_prompt")))
        .when(kind == 3, F.concat(F.lit("s_"), type_, F.lit("_model_response")))
        .when(kind == 4, F.concat(F.lit("user_prompt_liwc_"), brand))
        .when(kind == 5, F.concat(F.lit("model_response_liwc_"), brand))
        .when(kind == 6, "flesch_reading_ease_user_prompt")
        .when(kind == 7, F.concat(F.lit("dummy_topic_age "), "p_type"))
        .otherwise(F.concat(F.lit("num_"), type_, F.lit("_model_response")))
    )
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_returnflag").alias("analysis"), feature.alias("feature")).agg(
        (F.regr_slope("l_extendedprice", "l_quantity") / 1000 - 0.95).alias("coefficient")
    )


MEMBERS = """members AS (
  SELECT analysis, feature, coefficient, 'topic' AS family FROM coefficients WHERE feature LIKE 'dummy\\_topic\\_%' ESCAPE '\\'
  UNION ALL SELECT analysis, feature, coefficient, 'demographic' FROM coefficients WHERE contains(feature, 'age')
  UNION ALL SELECT analysis, feature, coefficient, 'emotion' FROM coefficients WHERE starts_with(feature, 'e_')
  UNION ALL SELECT analysis, feature, coefficient, 'sentiment' FROM coefficients WHERE starts_with(feature, 's_')
  UNION ALL SELECT analysis, feature, coefficient, 'liwc' FROM coefficients WHERE contains(feature, '_liwc_')
  UNION ALL SELECT analysis, feature, coefficient, 'reading_ease' FROM coefficients WHERE starts_with(feature, 'flesch')
  UNION ALL SELECT analysis, feature, coefficient, 'linguistic' FROM coefficients WHERE starts_with(feature, 'num_'))"""

IMPORTANCE = f"""WITH {COEFFICIENTS}, {MEMBERS},
  families AS (SELECT unnest(['topic', 'demographic', 'emotion', 'politeness', 'sentiment', 'concreteness',
    'reading_ease', 'liwc', 'linguistic']) AS family),
  every AS (SELECT DISTINCT analysis, family FROM coefficients, families),
  importance AS (SELECT e.analysis, e.family,
    coalesce(max(abs(coefficient)), 0) AS max_importance,
    coalesce(avg(abs(coefficient)), 0) AS mean_importance
  FROM every e LEFT JOIN members m ON m.analysis = e.analysis AND m.family = e.family GROUP BY 1, 2)"""


@query(
    "agg18_family_importance",
    IMPORTANCE
    + """ SELECT analysis, family, round(max_importance, 6) AS max_importance,
      round(mean_importance, 6) AS mean_importance FROM importance""",
)
def _(t):
    rows = family_importance(coefficients_view(t), ["analysis"], ["age"])
    return rows.select("analysis", "family", *rounded("max_importance", "mean_importance"))


@query(
    "agg18_side_importance",
    f"""WITH {COEFFICIENTS} SELECT analysis, CASE WHEN contains(feature, 'user_prompt') THEN 'user' ELSE 'model' END AS side,
      round(max(abs(coefficient)), 6) AS max_importance, round(avg(abs(coefficient)), 6) AS mean_importance
    FROM coefficients WHERE contains(feature, 'user_prompt') OR contains(feature, 'model_response') GROUP BY 1, 2""",
)
def _(t):
    rows = side_importance(coefficients_view(t), ["analysis"])
    return rows.select("analysis", "side", *rounded("max_importance", "mean_importance"))


@query(
    "agg19_importance_change",
    f"""WITH {COEFFICIENTS}, d AS (SELECT analysis, feature, abs(coefficient) AS c FROM coefficients
      WHERE contains(feature, 'age'))
    SELECT a.analysis, round(median(100 * (coalesce(b.c, 0) - a.c) / a.c), 5) AS median_change,
      count(*) AS n_features
    FROM d a LEFT JOIN d b ON a.feature = b.feature AND b.analysis = 'R'
      AND b.feature NOT LIKE '%Brand#1%' GROUP BY 1""",
)
def _(t):
    reduced = coefficients_view(t)
    full = reduced.filter((F.col("analysis") == "R") & ~F.contains("feature", F.lit("Brand#1")))
    spread = full.withColumn("analysis", F.explode(F.array(*[F.lit(a) for a in "ANR"])))
    rows = importance_change(spread, reduced, ["analysis"], ["age"])
    return rows.select("analysis", *rounded("median_change", digits=5), "n_features")
