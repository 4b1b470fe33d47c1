from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.aggregates import OUTCOME_ROWS, answers_view, questions_view
from turnwise.catalog.registry import DEMOGRAPHICS, LONG, MARKERS, OUTCOMES, query, rounded
from turnwise.functions.tails import chi2_tail, f_tail, t_tail
from turnwise.operators.aggregates import group_means
from turnwise.operators.classification import (
    class_scores,
    confusion_counts,
    majority_baseline,
    random_baseline,
    summary_scores,
)
from turnwise.operators.dominance import aso
from turnwise.operators.filters import known, recode
from turnwise.operators.pairs import pair_table
from turnwise.operators.reshape import unpivot_demographics
from turnwise.operators.tests_of_difference import (
    anova,
    anova_from_stats,
    chi2_one_vs_rest,
    significant,
    ttest_from_stats,
    with_chi2_tail,
    with_f_tail,
    with_t_tail,
)
from turnwise.plans.disparity import disparity, outcomes, overview
from turnwise.plans.inference import inference_scores, inferred_labels

WITH_OUT = f"WITH {OUTCOMES} "


def _long(t):
    long = unpivot_demographics(t.outcomes, ["conversation_id", "topic", "outcome"], DEMOGRAPHICS)
    return known(long, "group", MARKERS)


# Sums of squares per key from group summaries g(key, grp, n, m, v).
def _anova_sql(keys: str, cte: str) -> str:
    return f"""{cte}, g AS (SELECT {keys}, grp, count(*) AS n, avg(outcome) AS m,
      coalesce(var_samp(outcome), 0) AS v FROM long GROUP BY {keys}, grp),
    w AS (SELECT *, sum(n * m) OVER (PARTITION BY {keys}) / sum(n) OVER (PARTITION BY {keys}) AS grand FROM g),
    a AS (SELECT {keys}, count(*) AS k, sum(n) AS nt, sum(n * (m - grand) * (m - grand)) AS ssb,
      sum((n - 1) * v) AS ssw, max(m) - min(m) AS spread FROM w GROUP BY {keys})"""


@query(
    "st1_anova",
    f"""WITH {_anova_sql('topic, demo', LONG)} SELECT topic, demo, k AS n_groups, CAST(nt AS BIGINT) AS n_total,
      round((ssb / (k - 1)) / (ssw / (nt - k)), 6) AS f_value, k - 1 AS df_between,
      CAST(nt - k AS BIGINT) AS df_within, round(spread, 4) AS diff_mean FROM a""",
)
def _(t):
    table = anova(_long(t), ["topic", "demo"], "group", "outcome")
    return table.select(
        "topic", "demo", "n_groups", "n_total", F.round("F", 6).alias("f_value"), "df_between", "df_within",
        *rounded("diff_mean", digits=4),
    )


@query(
    "st2_anova_from_stats",
    f"""WITH {_anova_sql('demo', LONG)} SELECT demo, round(ssb / 1e9, 6) AS ss_between, round(ssw / 1e9, 6) AS ss_within,
      round(ssb / (k - 1) / 1e9, 6) AS ms_between, round(ssw / (nt - k) / 1e9, 6) AS ms_within,
      round((ssb / (k - 1)) / (ssw / (nt - k)), 6) AS f_value, 'ok' AS status FROM a""",
)
def _(t):
    table = anova_from_stats(group_means(_long(t), ["demo"], "group", "outcome"), ["demo"], min_n=2)
    squares = ["ss_between", "ss_within", "ms_between", "ms_within"]
    return table.select(
        "demo",
        *[F.round(F.col(c) / 1e9, 6).alias(c) for c in squares],
        F.round("F", 6).alias("f_value"),
        "status",
    )


# With three groups the tail of F has a closed form.
_TAIL = """p AS (SELECT *, (ssb / (k - 1)) / (ssw / (nt - k)) AS f FROM a),
    tail AS (SELECT *, pow(1 + 2 * f / (nt - k), -(nt - k) / 2) AS p_f FROM p)"""


def _status(t):
    rows = t.outcomes.withColumn("demo", F.lit("status"))
    return anova(rows, ["topic", "demo"], "status", "outcome")


_STATUS = _anova_sql(
    "topic", f"{OUTCOMES}, long AS (SELECT topic, outcome, status AS grp FROM out)"
)


@query(
    "st3_significance",
    f"""WITH {_STATUS}, {_TAIL} SELECT topic, round(p_f, 7) AS p_value, p_f < 0.25 AS diff,
      CASE WHEN p_f < 0.25 THEN round(spread, 4) END AS diff_mean FROM tail""",
)
def _(t):
    table = significant(with_f_tail(_status(t)), alpha=0.25)
    return table.select(
        "topic", *rounded("p_value", digits=7), "diff", *rounded("diff_mean", digits=4)
    )


@query(
    "st9_tails_in_closed_form",
    f"""WITH {_STATUS}, {_TAIL} SELECT topic, round(p_f, 8) AS p_f, round(exp(-f), 8) AS p_chi2 FROM tail""",
)
def _(t):
    table = _status(t)
    return table.select(
        "topic",
        F.round(f_tail(F.col("F"), F.col("df_between"), F.col("df_within")), 8).alias("p_f"),
        F.round(chi2_tail(2 * F.col("F"), F.lit(2)), 8).alias("p_chi2"),
    )


@query(
    "st4_chi2_one_vs_rest",
    f"""WITH {LONG}, c AS (
      SELECT demo, topic, grp, count(l.conversation_id) AS o FROM (
        SELECT d.demo, d.grp, x.topic FROM (SELECT DISTINCT demo, grp FROM long) d, (SELECT DISTINCT topic FROM long) x) g
      LEFT JOIN long l USING (demo, topic, grp) GROUP BY 1, 2, 3),
    w AS (SELECT *, sum(o) OVER (PARTITION BY demo, topic) AS r, sum(o) OVER (PARTITION BY demo, grp) AS gt,
      sum(o) OVER (PARTITION BY demo) AS n, count(*) OVER (PARTITION BY demo, topic) AS k FROM c),
    e AS (SELECT *, r * gt / n AS e1, (n - r) * gt / n AS e2, abs(o - r * gt / n) AS d FROM w),
    y AS (SELECT *, d - CASE WHEN k = 2 THEN least(d, 0.5) ELSE 0 END AS dd FROM e)
    SELECT demo, topic, CAST(min(r) AS BIGINT) AS n, round(sum(dd * dd / e1 + dd * dd / e2), 6) AS statistic,
      min(k) - 1 AS df FROM y GROUP BY 1, 2""",
)
def _(t):
    table = chi2_one_vs_rest(_long(t), ["demo"], "topic", "group")
    return table.select("demo", "topic", "n", *rounded("statistic"), "df")


@query(
    "st4_chi2_two_groups",
    """WITH c AS (SELECT lang, source, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    g AS (SELECT a.source, b.quality, count(c.lang) AS o FROM (SELECT DISTINCT source FROM c) a
      CROSS JOIN (SELECT DISTINCT quality FROM c) b
      LEFT JOIN c ON c.source = a.source AND c.quality = b.quality GROUP BY 1, 2),
    w AS (SELECT *, sum(o) OVER (PARTITION BY source) AS r, sum(o) OVER (PARTITION BY quality) AS gt,
      sum(o) OVER () AS n FROM g),
    y AS (SELECT source, r, r * gt / n AS e1, (n - r) * gt / n AS e2,
      abs(o - r * gt / n) - least(abs(o - r * gt / n), 0.5) AS d FROM w)
    SELECT source, CAST(min(r) AS BIGINT) AS n, round(sum(d * d / e1 + d * d / e2), 6) AS statistic, CAST(1 AS BIGINT) AS df
    FROM y GROUP BY 1""",
)
def _(t):
    rows = t.documents.join(t.labels, "doc_id")
    table = chi2_one_vs_rest(rows, [], "source", "quality")
    return table.select("source", "n", *rounded("statistic"), "df")


# The 2×2 table from ranks: Σ|x−y| over ordered pairs is 2·Σ x·(2·rank − n − 1).
_PAIRS = f"""WITH {LONG}, blocks AS (
    SELECT demo, 'gt' AS kind, grp AS bg, topic AS bt, outcome AS x FROM long
    UNION ALL SELECT demo, 'g', grp, '', outcome FROM long
    UNION ALL SELECT demo, 't', '', topic, outcome FROM long
    UNION ALL SELECT demo, 'all', '', '', outcome FROM long),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY demo, kind, bg, bt ORDER BY x) AS r,
    count(*) OVER (PARTITION BY demo, kind, bg, bt) AS n FROM blocks),
  totals AS (SELECT demo, kind, bg, bt, CAST(count(*) AS DOUBLE) AS n, 2 * sum(x * (2 * r - n - 1)) AS s,
    2 * CAST(count(*) AS DOUBLE) * count(*) * var_pop(x) AS q FROM ranked GROUP BY 1, 2, 3, 4),
  k AS (SELECT kind, sum(n * n) AS p, sum(s) AS s, sum(q) AS q FROM totals GROUP BY 1),
  v AS (SELECT max(p) FILTER (WHERE kind = 'gt') AS pgt, max(s) FILTER (WHERE kind = 'gt') AS sgt, max(q) FILTER (WHERE kind = 'gt') AS qgt,
    max(p) FILTER (WHERE kind = 'g') AS pg, max(s) FILTER (WHERE kind = 'g') AS sg, max(q) FILTER (WHERE kind = 'g') AS qg,
    max(p) FILTER (WHERE kind = 't') AS pt, max(s) FILTER (WHERE kind = 't') AS st, max(q) FILTER (WHERE kind = 't') AS qt,
    max(p) FILTER (WHERE kind = 'all') AS pa, max(s) FILTER (WHERE kind = 'all') AS sa, max(q) FILTER (WHERE kind = 'all') AS qa FROM k),
  cells AS (
    SELECT 'same_group_same_topic' AS cell, pgt AS p, sgt AS s, qgt AS q FROM v
    UNION ALL SELECT 'diff_group_same_topic', pt - pgt, st - sgt, qt - qgt FROM v
    UNION ALL SELECT 'same_group_diff_topic', pg - pgt, sg - sgt, qg - qgt FROM v
    UNION ALL SELECT 'diff_group_diff_topic', pa - pg - pt + pgt, sa - sg - st + sgt, qa - qg - qt + qgt FROM v),
  pair_cells AS (SELECT cell, p AS n, s / p AS mean, (q - s * s / p) / (p - 1) AS var FROM cells)"""


def _pair_cells(t):
    return pair_table(t.outcomes, DEMOGRAPHICS, "topic", "outcome", markers=MARKERS)


@query(
    "st5_ttest_from_stats",
    _PAIRS
    + """, c AS (SELECT a.cell AS first, b.cell AS second, (a.mean - b.mean) / sqrt(
        ((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t, a.n + b.n - 2 AS df
      FROM pair_cells a, pair_cells b
      WHERE (a.cell, b.cell) IN (('same_group_same_topic', 'same_group_diff_topic'),
        ('same_group_same_topic', 'diff_group_same_topic'),
        ('same_group_diff_topic', 'diff_group_diff_topic'),
        ('diff_group_same_topic', 'diff_group_diff_topic')))
    SELECT first, second, round(t, 5) AS t, df FROM c""",
)
def _(t):
    tests = ttest_from_stats(_pair_cells(t))
    return tests.select("first", "second", *rounded("t", digits=5), "df")


@query(
    "st6_pair_table",
    _PAIRS
    + """ SELECT cell, CAST(n AS DECIMAL(38,0)) AS n, round(mean, 4) AS mean, round(sqrt(var), 4) AS sd FROM pair_cells""",
)
def _(t):
    return _pair_cells(t).select("cell", "n", *rounded("mean", "sd", digits=4))


@query(
    "st7_class_scores",
    """WITH c AS (SELECT lang, quality AS a, toxic AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
    s AS (SELECT lang, label, sum(CAST(a = label AND p = label AS INT)) AS hits, sum(CAST(a = label AS INT)) AS support,
      sum(CAST(p = label AS INT)) AS claimed FROM c, (SELECT 0 AS label UNION ALL SELECT 1) GROUP BY 1, 2)
    SELECT lang, label, round(coalesce(hits / nullif(claimed, 0), 0), 6) AS precision,
      round(coalesce(hits / nullif(support, 0), 0), 6) AS recall,
      round(coalesce(2 * hits / nullif(claimed + support, 0), 0), 6) AS f1,
      CAST(support AS BIGINT) AS support FROM s WHERE support + claimed > 0""",
)
def _(t):
    rows = t.documents.join(t.labels, "doc_id")
    scores = class_scores(confusion_counts(rows, ["lang"], "quality", "toxic"), ["lang"])
    return scores.select("lang", "label", *rounded("precision", "recall", "f1"), "support")


_SUMMARY = """, s AS (SELECT label, sum(CAST(a = label AND p = label AS INT)) AS hits, sum(CAST(a = label AS INT)) AS support,
      sum(CAST(p = label AS INT)) AS claimed
      FROM c, (SELECT a AS label FROM c UNION SELECT p FROM c) GROUP BY 1),
    f AS (SELECT *, coalesce(2 * hits / nullif(claimed + support, 0), 0) AS f1 FROM s)
    SELECT round(sum(hits) / sum(support), 6) AS micro_f1, round(avg(f1), 6) AS macro_f1,
      round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f"""
_SCORE_COLUMNS = ["micro_f1", "macro_f1", "weighted_f1"]


@query("st7_summary_scores", "WITH c AS (SELECT quality AS a, toxic AS p FROM labels)" + _SUMMARY)
def _(t):
    scores = summary_scores(confusion_counts(t.labels, [], "quality", "toxic"), [])
    return scores.select(*rounded(*_SCORE_COLUMNS))


@query(
    "st8_majority_baseline",
    """WITH m AS (SELECT arg_min(lang, (-n, lang)) AS p FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)),
    c AS (SELECT lang AS a, p FROM documents, m)"""
    + _SUMMARY,
)
def _(t):
    guessed = majority_baseline(t.documents.select("doc_id", "lang"), [], "lang")
    return summary_scores(confusion_counts(guessed, [], "lang", "majority"), []).select(
        *rounded(*_SCORE_COLUMNS)
    )


@query(
    "st8_random_baseline",
    """WITH l AS (SELECT list_sort(list(DISTINCT lang)) AS classes FROM documents),
    c AS (SELECT lang AS a, classes[1 + CAST('0x' || left(md5(concat_ws('#', CAST(doc_id AS VARCHAR), '3')), 8) AS BIGINT)
      % len(classes)] AS p FROM documents, l)"""
    + _SUMMARY,
)
def _(t):
    guessed = random_baseline(t.documents.select("doc_id", "lang"), [], "lang", "doc_id", 3)
    return summary_scores(confusion_counts(guessed, [], "lang", "random"), []).select(
        *rounded(*_SCORE_COLUMNS)
    )


@query("st9_tail_probabilities")
def _(t):
    table = anova(_long(t), ["topic", "demo"], "group", "outcome")
    return table.select(
        "topic",
        "demo",
        f_tail(F.col("F"), F.col("df_between"), F.col("df_within")).alias("p_f"),
        chi2_tail(F.col("F") * F.col("df_between"), F.col("df_between")).alias("p_chi2"),
        t_tail(F.sqrt("F"), F.col("df_within")).alias("p_t"),
    )


def _violation_sql(rows: str) -> str:
    """Violation ratio on the quantile grid 0.005 … 0.995 of rows(by, a, b)."""
    return f"""WITH {rows}, s AS (SELECT k, count(*) AS n, list(a ORDER BY a) AS la, list(b ORDER BY b) AS lb FROM rows GROUP BY 1),
    g AS (SELECT k, CAST(ceil(n * i / 200.0::DOUBLE - 1e-9) AS BIGINT) AS pos, la, lb FROM s, (SELECT unnest(generate_series(1, 199)) AS i)),
    q AS (SELECT k, lb[pos] - la[pos] AS gap FROM g)
    SELECT k, round(sum(pow(greatest(gap, 0), 2)) / sum(gap * gap), 7) AS violation FROM q GROUP BY 1"""


@query(
    "st10_violation_ratio",
    _violation_sql("rows AS (SELECT l_returnflag AS k, l_quantity AS a, l_tax * 600 AS b FROM lineitem)"),
)
def _(t):
    lines = t.lineitem.select(
        F.col("l_returnflag").alias("k"), "l_quantity", (F.col("l_tax") * 600).alias("level")
    )
    return aso(lines, ["k"], "l_quantity", "level", replicates=20).select(
        "k", *rounded("violation", digits=7)
    )


@query(
    "st10_violation_ratio_ranked",
    _violation_sql(
        f"{OUTCOMES}, rows AS (SELECT segment AS k, outcome AS a, outcome * 0.97 + 7500 AS b FROM out)"
    ),
)
def _(t):
    prices = t.outcomes.select(
        F.col("segment").alias("k"), "outcome", (F.col("outcome") * 0.97 + 7500).alias("other")
    )
    return aso(prices, ["k"], "outcome", "other", replicates=20).select(
        "k", *rounded("violation", digits=7)
    )


@query("st10_almost_stochastic_order")
def _(t):
    lines = t.lineitem.withColumn("level", F.col("l_tax") * 600)
    return aso(lines, ["l_returnflag"], "l_quantity", "level", seed=42)


@query(
    "st10_constant_samples",
    """SELECT l_returnflag AS k, CAST(count(*) AS BIGINT) AS n_first, CAST(count(*) AS BIGINT) AS n_second,
      CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS violation,
      CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS aso
    FROM lineitem GROUP BY l_returnflag""",
)
def _(t):
    """Every draw of a constant sample is the sample, so the score is the violation itself."""
    level = F.when(F.col("l_returnflag") == "A", 2).otherwise(1)
    lines = t.lineitem.select(F.col("l_returnflag").alias("k"), (3 - level).alias("first"), level.alias("second"))
    return aso(lines, ["k"], "first", "second", seed=1)


@query(
    "st10_samples_apart",
    """SELECT l_returnflag AS k, l_linestatus AS s, count(*) AS n_first, count(*) AS n_second,
      CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS violation,
      CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS aso
    FROM lineitem GROUP BY ALL""",
)
def _(t):
    """Where all of one sample lies above the other, every draw does, whatever values it has."""
    apart = F.when(F.col("l_returnflag") == "N", 1).otherwise(-1) * (100 + 1000 * F.col("l_tax"))
    lines = t.lineitem.select(
        F.col("l_returnflag").alias("k"), F.col("l_linestatus").alias("s"), F.col("l_quantity").alias("first"),
        (F.col("l_quantity") + apart).alias("second"),
    )
    return aso(lines, ["k", "s"], "first", "second", seed=1)


@query("st10_almost_stochastic_order_ranked")
def _(t):
    prices = t.outcomes.select("segment", "outcome", (F.col("outcome") * 0.99 + 500).alias("other"))
    return aso(prices, ["segment"], "outcome", "other", seed=42)


@query(
    "e2_disparity",
    f"""WITH {OUTCOME_ROWS}, {OUTCOMES}, joined AS (
      SELECT model, domain, r.outcome, segment, region, status FROM outcome_rows r JOIN out USING (conversation_id)),
    long AS (SELECT model, domain, outcome, demo, grp FROM (
      SELECT model, domain, outcome, 'segment' AS demo, segment AS grp FROM joined
      UNION ALL SELECT model, domain, outcome, 'region', region FROM joined
      UNION ALL SELECT model, domain, outcome, 'status', status FROM joined)
      WHERE grp NOT IN ('HOUSEHOLD', 'AFRICA'))"""
    + _anova_sql("model, domain, demo", "")
    + """ SELECT model, domain, demo, k AS n_groups, CAST(nt AS BIGINT) AS n_total, CAST(nt - k AS BIGINT) AS df_within,
      round((ssb / (k - 1)) / (ssw / (nt - k)), 6) AS f_value, round(spread, 5) AS diff_mean FROM a""",
)
def _(t):
    table = disparity_of_orders(t)
    return table.select(
        "model", "domain", "demo", "n_groups", "n_total", "df_within", F.round("F", 6).alias("f_value"),
        *rounded("diff_mean", digits=5),
    )


def disparity_of_orders(t):
    rows = outcomes(answers_view(t), questions_view(t), ["model", "conversation_id"])
    people = t.outcomes.select("conversation_id", *DEMOGRAPHICS)
    joined = rows.join(people, "conversation_id")
    return disparity(joined, ["model", "domain"], DEMOGRAPHICS, MARKERS)


@query("e2_overview")
def _(t):
    return overview(disparity_of_orders(t))


@query("e3_topic_association")
def _(t):
    return with_chi2_tail(chi2_one_vs_rest(_long(t), ["demo"], "topic", "group"))


@query("e3_pair_tests")
def _(t):
    return with_t_tail(ttest_from_stats(_pair_cells(t)))


# Words for the statuses that no other word of a response holds.
_STATUS_WORDS = {"F": "FINISHED", "O": "ONGOING", "P": "PENDING"}


# Responses about the orders: two thirds name the right segment and status, the rest another one.
def _responses(t):
    off = F.col("conversation_id") % 3 == 0
    segment = F.when(off, "BUILDING").otherwise(F.col("segment"))
    status = F.when(off, F.when(F.col("status") == "F", "O").otherwise("F")).otherwise(F.col("status"))
    status = recode(status, _STATUS_WORDS)
    answer = F.to_json(F.struct(segment.alias("Segment"), status.alias("Order status")))
    sentence = F.concat(F.lit("It is "), segment, F.lit(", and the order is "), status)
    return t.outcomes.select(
        F.concat(F.lit("request-"), "conversation_id").alias("custom_id"),
        F.when(F.col("conversation_id") % 5 == 0, sentence).otherwise(answer).alias("content"),
    )


def _inferred(t):
    labels = {
        "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"],
        "status": list(_STATUS_WORDS.values()),
    }
    keys = {"segment": "Segment", "status": "Order status"}
    recodes = {"status": _STATUS_WORDS}
    rows = inferred_labels(_responses(t), t.outcomes, labels=labels, json_keys=keys, recodes=recodes, markers=["HOUSEHOLD"])
    letters = {word: letter for letter, word in _STATUS_WORDS.items()}
    return rows.withColumns({c: recode(F.col(c), letters) for c in ("true", "predicted")})


_INFERRED = WITH_OUT + """, r AS (SELECT conversation_id, segment, status, conversation_id % 3 = 0 AS off FROM out),
    c AS (SELECT 'segment' AS demo, segment AS a, CASE WHEN off THEN 'BUILDING' ELSE segment END AS p FROM r WHERE segment <> 'HOUSEHOLD'
      UNION ALL SELECT 'status', status, CASE WHEN NOT off THEN status WHEN status = 'F' THEN 'O' ELSE 'F' END FROM r)"""


@query(
    "st7_inferred_labels",
    _INFERRED + """ SELECT demo, a AS "true", p AS predicted, count(*) AS n FROM c GROUP BY 1, 2, 3""",
)
def _(t):
    return confusion_counts(_inferred(t), ["demo"], "true", "predicted")


@query("st8_inference_scores")
def _(t):
    return inference_scores(_inferred(t))
