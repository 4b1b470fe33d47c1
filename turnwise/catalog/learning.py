from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.registry import OUTCOMES, query, rounded, sql_hash_mod
from turnwise.config import L1_RATIOS, N_ALPHAS
from turnwise.operators.cross_moments import cross_moments, dense_moments, feature_names, with_intercept
from turnwise.operators.gram import gram, gram_long, merge
from turnwise.operators.importance import families_of, importance_change
from turnwise.operators.probe import (
    better_layers,
    probe_dataset,
    probe_predictions,
    probe_scores,
    with_dominance,
)
from turnwise.operators.ranking import assign_fold
from turnwise.operators.regression import (
    best_penalty,
    elastic_net_cv_from_gram,
    elastic_net_fit,
    elastic_net_grid,
    ols,
    ols_from_gram,
    standardise,
    vif_step,
)
from turnwise.session import cut_lineage
from turnwise.sources.tables import spread

REGRESSORS = ["l_quantity", "l_extendedprice", "p_size", "p_retailprice"]
TARGET = "charge"


def _lines(t):
    """Order lines with the price paid, which depends on the discount (read as the topic) and on
    the tax (read as a demographic)."""
    part = t.part.select("p_partkey", "p_size", "p_retailprice")
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    lines = spread(
        t.lineitem.select(
            "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
        )
    )
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey",
        *REGRESSORS,
        (price * (1 - discount) * (1 + tax)).alias(TARGET),
        F.concat(F.lit("d"), F.round(discount * 100).cast("int")).alias("topic"),
        F.concat(F.lit("t"), F.round(tax * 100).cast("int")).alias("age"),
    )


def _moments(t, keys=()):
    """Cross moments of scaled regressors and two groups, read in one scan, and the columns of a fit."""
    lines = assign_fold(_lines(t), "l_orderkey", 5, 42) if keys else _lines(t)
    cross = cross_moments(lines, REGRESSORS, ["topic", "age"], TARGET, keys)
    return cross, feature_names(cross)


@query(
    "ml1_standardise",
    """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal
    FROM customer""",
)
def _(t):
    scaled = standardise(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return scaled.select("c_custkey", *rounded("c_acctbal"))


@query(
    "ml2_ols_one_regressor",
    """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS coefficient,
      round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
      round(regr_r2(l_extendedprice, l_quantity), 7) AS r2, count(*) AS n
    FROM lineitem GROUP BY 1""",
)
def _(t):
    fit = ols(t.lineitem, "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    return fit.select(
        "l_returnflag", *rounded("coefficient", digits=5), *rounded("intercept", digits=4),
        *rounded("r2", digits=7), "n",
    )


@query("ml2_ols")
def _(t):
    cross, xs = _moments(t)
    return with_intercept(ols_from_gram(dense_moments(cross, xs), xs), cross)


@query(
    "ml2_ols_two_regressors",
    """WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my,
        var_pop(l_quantity) AS a, var_pop(l_discount) AS b, covar_pop(l_quantity, l_discount) AS ab,
        covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS byy, var_pop(l_extendedprice) AS yy
      FROM lineitem GROUP BY 1),
    w AS (SELECT *, (ay * b - byy * ab) / (a * b - ab * ab) AS wa, (byy * a - ay * ab) / (a * b - ab * ab) AS wb FROM m)
    SELECT l_returnflag, unnest(['l_quantity', 'l_discount']) AS feature, round(unnest([wa, wb]), 4) AS coefficient,
      round(my - wa * ma - wb * mb, 4) AS intercept, round((wa * ay + wb * byy) / yy, 7) AS r2, n FROM w""",
)
def _(t):
    cross = cross_moments(t.lineitem, ["l_quantity", "l_discount"], [], "l_extendedprice", ["l_returnflag"])
    xs = feature_names(cross)
    fit = with_intercept(ols_from_gram(dense_moments(cross, xs, scale=False), xs, ["l_returnflag"]), cross)
    return fit.select("l_returnflag", "feature", *rounded("coefficient", "intercept", digits=4), *rounded("r2", digits=7), "n")


def _net(t):
    """One regressor and a fold per line number, where every fit has a closed form."""
    price = F.col("l_extendedprice") / 1000
    rows = t.lineitem.select(
        F.col("l_linenumber").alias("fold"),
        price.alias("x"),
        (price * (1 - F.col("l_discount"))).alias("y"),
    )
    return gram(rows, ["x"], "y", ["fold"])


_NET = """d AS (SELECT l_linenumber AS fold, l_extendedprice / 1000 AS x,
    l_extendedprice / 1000 * (1 - l_discount) AS y FROM lineitem)"""


@query(
    "ml3_elastic_net_grid",
    f"""WITH {_NET},
    train AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v
      FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY 1),
    grid AS (SELECT l1, i, abs((SELECT covar_pop(x, y) FROM d)) / l1 * pow(0.001, i / {N_ALPHAS - 1}.0) AS alpha
      FROM (SELECT unnest({L1_RATIOS}::DOUBLE[]) AS l1), (SELECT unnest(range({N_ALPHAS})) AS i)),
    fit AS (SELECT fold, l1, i, alpha, mx, my,
      sign(c) * greatest(abs(c) - alpha * l1, 0) / (v + alpha * (1 - l1)) AS w FROM train, grid)
    SELECT f.fold, l1 AS l1_ratio, CAST(i AS INT) AS alpha_index, round(any_value(alpha), 5) AS alpha,
      round(avg(pow(y - my - w * (x - mx), 2)), 5) AS mse
    FROM fit f JOIN d ON d.fold = f.fold GROUP BY 1, 2, 3""",
)
def _(t):
    grid = elastic_net_grid(_net(t), "fold")
    return grid.select("fold", "l1_ratio", "alpha_index", *rounded("alpha", "mse", digits=5))


@query(
    "ml3_elastic_net_fit",
    f"""WITH {_NET}, m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v,
      var_pop(y) AS vy, count(*) AS n FROM d),
    w AS (SELECT *, (c - 30 * 0.7) / (v + 30 * 0.3) AS w FROM m)
    SELECT 'x' AS feature, round(w, 7) AS coefficient, round(my - w * mx, 6) AS intercept,
      round(1 - (vy - 2 * w * c + w * w * v) / vy, 7) AS r2, n FROM w""",
)
def _(t):
    moments = merge(_net(t), [])
    penalty = moments.select(F.lit(30.0).alias("alpha"), F.lit(0.7).alias("l1_ratio"))
    fit = elastic_net_fit(moments, penalty, ["x"])
    return fit.select(
        "feature", *rounded("coefficient", digits=7), *rounded("intercept"), *rounded("r2", digits=7), "n"
    )


@query("ml3_elastic_net_cv")
def _(t):
    cross, xs = _moments(t, ["fold"])
    return with_intercept(elastic_net_cv_from_gram(dense_moments(cross, xs), xs, "fold"), cross)


@query(
    "ml4_vif_of_two",
    """WITH v AS (SELECT l_returnflag, 1 / (1 - pow(corr(l_extendedprice, l_extendedprice * (1 - l_discount) + 1000 * l_quantity), 2)) AS v
      FROM lineitem GROUP BY 1)
    SELECT l_returnflag, unnest(['price', 'mix']) AS feature, round(v, 4) AS vif FROM v""",
)
def _(t):
    price = F.col("l_extendedprice")
    rows = t.lineitem.select(
        "l_returnflag",
        price.alias("price"),
        (price * (1 - F.col("l_discount")) + 1000 * F.col("l_quantity")).alias("mix"),
    )
    table = vif_step(rows, ["price", "mix"], threshold=1e6, intercept=True, by=["l_returnflag"])
    return table.select("l_returnflag", "feature", *rounded("vif", digits=4))


# A column's factor of three is its cofactor over the determinant of the correlations; behind the removal
# both others have that of two.
@query(
    "ml4_vif_of_three",
    """WITH x AS (SELECT l_returnflag, l_quantity::DOUBLE AS a, l_extendedprice::DOUBLE AS b,
        l_extendedprice::DOUBLE + 3000 * l_quantity::DOUBLE + 100000 * l_discount::DOUBLE AS c FROM lineitem),
      r AS (SELECT l_returnflag, corr(a, b) AS ab, corr(a, c) AS ac, corr(b, c) AS bc FROM x GROUP BY 1),
      d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r),
      f AS (SELECT l_returnflag, unnest([
        {'feature': 'a', 'vif': (1 - bc * bc) / det, 'rest': 1 / (1 - bc * bc)},
        {'feature': 'b', 'vif': (1 - ac * ac) / det, 'rest': 1 / (1 - ac * ac)},
        {'feature': 'c', 'vif': (1 - ab * ab) / det, 'rest': 1 / (1 - ab * ab)}], recursive := true) FROM d),
      w AS (SELECT l_returnflag, max(vif) AS most, arg_max(rest, vif) AS rest FROM f GROUP BY 1)
    SELECT l_returnflag, feature, CASE WHEN most > 10 AND vif = most THEN 1 END::INT AS step,
      round(CASE WHEN most > 10 AND vif < most THEN w.rest ELSE vif END, 4) AS vif FROM f JOIN w USING (l_returnflag)""",
)
def _(t):
    quantity, price, discount = (F.col(f"l_{c}").cast("double") for c in ("quantity", "extendedprice", "discount"))
    rows = t.lineitem.select(
        "l_returnflag", quantity.alias("a"), price.alias("b"), (price + 3000 * quantity + 100000 * discount).alias("c")
    )
    table = vif_step(rows, ["a", "b", "c"], threshold=10.0, intercept=True, by=["l_returnflag"])
    return table.select("l_returnflag", "feature", "step", *rounded("vif", digits=4))


@query("ml4_vif_step")
def _(t):
    lines = _lines(t).withColumn("_mix", F.col("l_quantity") + F.col("p_size"))
    return vif_step(lines, [*REGRESSORS, "_mix"], intercept=True)


@query("ml5_refit_without_topics")
def _(t):
    cross, xs = _moments(t, ["fold"])
    moments = cut_lineage(dense_moments(cross, xs))
    penalty = cut_lineage(best_penalty(elastic_net_grid(moments, "fold")))
    total = merge(moments, [])
    topics = [x for x in xs if x.startswith("dummy_topic_")]
    full = elastic_net_fit(total, penalty, xs)
    reduced = elastic_net_fit(total, penalty, xs, without=topics)
    return importance_change(full, reduced, [], ["age"])


@query(
    "ml6_feature_families",
    """WITH f AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'dummy_topic_' || p_type WHEN 1 THEN 'dummy_age_' || p_type
      WHEN 2 THEN 'user_prompt_liwc_' || p_brand ELSE 'num_' || p_name END AS feature FROM part)
    SELECT feature, CASE WHEN starts_with(feature, 'dummy_topic_') THEN 'topic' WHEN starts_with(feature, 'dummy_age') THEN 'demographic'
      WHEN contains(feature, '_liwc_') THEN 'liwc' ELSE 'linguistic' END AS family FROM f""",
)
def _(t):
    kind = F.col("p_size") % 4
    feature = (
        F.when(kind == 0, F.concat(F.lit("dummy_topic_"), "p_type"))
        .when(kind == 1, F.concat(F.lit("dummy_age_"), "p_type"))
        .when(kind == 2, F.concat(F.lit("user_prompt_liwc_"), "p_brand"))
        .otherwise(F.concat(F.lit("num_"), "p_name"))
    )
    names = t.part.select(feature.alias("feature")).distinct()
    return names.withColumn("family", F.explode(families_of(F.col("feature"), ["age"])))


_CELLS = ["1", "l_quantity", "l_tax", "l_extendedprice"]


def _gram_sql() -> str:
    value = {c: ("1" if c == "1" else c) for c in _CELLS}
    parts = [
        f"""SELECT l_returnflag, '{a}' AS "left", '{b}' AS "right",
        round(sum(CAST({value[a]} AS DOUBLE) * {value[b]}) / count(*), 5) AS value FROM lineitem GROUP BY 1"""
        for a in _CELLS
        for b in _CELLS
    ]
    return " UNION ALL ".join(parts)


@query("ml7_gram", _gram_sql())
def _(t):
    xs = _CELLS[1:-1]
    moments = gram(t.lineitem, xs, _CELLS[-1], ["l_returnflag"])
    cells = gram_long(
        moments.select("l_returnflag", "n", "moments"), ["l_returnflag", "n"], xs, _CELLS[-1]
    )
    return cells.select(
        "l_returnflag", "left", "right", F.round(F.col("value") / F.col("n"), 5).alias("value")
    )


def _layers(t):
    """The two halves of each vector, read as the representations of two layers."""
    halves = F.array(
        F.struct(F.lit(0).alias("layer"), F.slice("embedding", 1, 32).alias("features")),
        F.struct(F.lit(1).alias("layer"), F.slice("embedding", 33, 32).alias("features")),
    )
    label = F.when(F.col("label") < 5, "low").otherwise("high")
    return t.embeddings.select("vec_id", label.alias("group"), F.inline(halves))


@query("ml8_probe")
def _(t):
    predictions = probe_predictions(_layers(t), "group", "features", "layer", "vec_id", repeats=5)
    scores = with_dominance(probe_scores(predictions, "layer", "vec_id"), ["layer"])
    return better_layers(scores, ["layer"])


@query(
    "ml8_held_out_rows",
    f"""SELECT layer, cv, count(*) AS n, count(*) FILTER (label < 5) AS low FROM embeddings,
      (SELECT unnest([0, 1]) AS layer), (SELECT unnest(range(5))::INT AS cv)
    WHERE embedding IS NOT NULL AND {sql_hash_mod("concat_ws('/', CAST(vec_id AS VARCHAR), CAST(cv AS VARCHAR))", 0, 1000000)} < 250000
    GROUP BY ALL""",
)
def _(t):
    """How many rows each of the fits holds out, and predicts."""
    predictions = probe_predictions(_layers(t), "group", "features", "layer", "vec_id", repeats=5)
    return predictions.filter(F.col("predicted").isNotNull()).groupBy("layer", "cv").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("true") == "low").alias("low")
    )


@query(
    "ml9_probe_dataset_balanced",
    f"""WITH {OUTCOMES}, b AS (SELECT conversation_id, CASE region WHEN 'EUROPE' THEN 0 ELSE 1 END AS region,
      md5(concat_ws('#', CAST(conversation_id AS VARCHAR), '5')) AS h FROM out WHERE region IN ('EUROPE', 'AMERICA', 'ASIA'))
    SELECT conversation_id, region FROM (
      SELECT *, row_number() OVER (PARTITION BY region ORDER BY h) AS r FROM b)
    WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM b GROUP BY region))""",
)
def _(t):
    rules = {"region": (["EUROPE"], ["AMERICA", "ASIA"])}
    rows = t.outcomes.select("conversation_id", "region")
    return probe_dataset(rows, "region", "conversation_id", True, 5, rules)


@query(
    "ml9_probe_dataset",
    f"""WITH {OUTCOMES} SELECT conversation_id, region FROM out WHERE region NOT IN ('AFRICA', 'ASIA')""",
)
def _(t):
    rows = t.outcomes.select("conversation_id", "region")
    return probe_dataset(rows, "region", "conversation_id", False, markers=["AFRICA", "ASIA"])
