from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.registry import DEMOGRAPHICS, OUTCOMES, query
from turnwise.operators.reshape import (
    crosstab,
    dummies,
    dummies_long,
    flatten_scores,
    questions_to_columns,
    questions_to_rows,
    unpivot,
    unpivot_demographics,
)
from turnwise.operators.turns import unpivot_aligned

WITH_OUT = f"WITH {OUTCOMES} "


@query(
    "rsh1_unpivot",
    """SELECT l_orderkey, l_linenumber, 'l_tax' AS measure, l_tax AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem""",
)
def _(t):
    ids = ["l_orderkey", "l_linenumber"]
    return unpivot(t.lineitem, ids, ["l_tax", "l_discount"], "measure", "value")


@query(
    "rsh2_unpivot_aligned",
    WITH_OUT
    + """SELECT conversation_id, 'first' AS turn, segment AS user_prompt, outcome AS response FROM out
      WHERE segment <> 'BUILDING'
    UNION ALL SELECT conversation_id, 'second', region, outcome / 2 FROM out
    UNION ALL SELECT conversation_id, 'third', topic, outcome / 4 FROM out WHERE status = 'F'""",
)
def _(t):
    wide = t.outcomes.select(
        "conversation_id",
        F.nullif(F.col("segment"), F.lit("BUILDING")).alias("p1"),
        F.col("region").alias("p2"),
        F.when(F.col("status") == "F", F.col("topic")).alias("p3"),
        F.col("outcome").alias("r1"),
        (F.col("outcome") / 2).alias("r2"),
        (F.col("outcome") / 4).alias("r3"),
    )
    families = {
        name: {"user_prompt": f"p{i}", "response": f"r{i}"}
        for i, name in enumerate(("first", "second", "third"), 1)
    }
    return unpivot_aligned(wide, ["conversation_id"], families, "turn", "user_prompt")


@query(
    "rsh3_crosstab",
    WITH_OUT
    + """SELECT topic, count(*) FILTER (WHERE segment = 'AUTOMOBILE') AS "AUTOMOBILE",
      count(*) FILTER (WHERE segment = 'BUILDING') AS "BUILDING",
      count(*) FILTER (WHERE segment = 'FURNITURE') AS "FURNITURE",
      count(*) FILTER (WHERE segment = 'HOUSEHOLD') AS "HOUSEHOLD",
      count(*) FILTER (WHERE segment = 'MACHINERY') AS "MACHINERY"
    FROM out GROUP BY 1""",
)
def _(t):
    return crosstab(t.outcomes, "topic", "segment")


_QUESTIONS = [str(i) for i in range(1, 8)]


@query(
    "rsh4_question_columns_and_rows",
    """SELECT l_orderkey, 'q_' || l_linenumber AS q_id, round(avg(l_quantity), 6) AS answer
    FROM lineitem GROUP BY l_orderkey, l_linenumber""",
)
def _(t):
    answers = t.lineitem.withColumn("q_id", F.concat(F.lit("q_"), "l_linenumber"))
    wide = questions_to_columns(
        answers, ["l_orderkey"], "q_id", F.avg("l_quantity"), [f"q_{i}" for i in _QUESTIONS]
    )
    rows = questions_to_rows(wide, ["l_orderkey"]).filter(F.col("answer").isNotNull())
    return rows.withColumn("answer", F.round("answer", 6))


@query(
    "rsh5_unpivot_demographics",
    WITH_OUT
    + """SELECT conversation_id, outcome, 'segment' AS demo, segment AS "group" FROM out
    UNION ALL SELECT conversation_id, outcome, 'region', region FROM out
    UNION ALL SELECT conversation_id, outcome, 'status', status FROM out""",
)
def _(t):
    return unpivot_demographics(t.outcomes, ["conversation_id", "outcome"], DEMOGRAPHICS)


@query(
    "rsh6_dummies",
    WITH_OUT
    + """SELECT conversation_id, CAST(status = 'F' AS INT) AS "dummy_status_F",
      CAST(status = 'P' AS INT) AS "dummy_status_P",
      CAST(region = 'AFRICA' AS INT) AS "dummy_region_AFRICA",
      CAST(region = 'AMERICA' AS INT) AS "dummy_region_AMERICA",
      CAST(region = 'ASIA' AS INT) AS "dummy_region_ASIA",
      CAST(region = 'EUROPE' AS INT) AS "dummy_region_EUROPE",
      CAST(region = 'MIDDLE EAST' AS INT) AS "dummy_region_MIDDLE EAST" FROM out""",
)
def _(t):
    nulled = t.outcomes.select(
        "conversation_id", F.nullif(F.col("status"), F.lit("O")).alias("status"), "region"
    )
    return dummies(nulled, ["status", "region"])


@query(
    "rsh6_dummies_long",
    WITH_OUT
    + """SELECT conversation_id, 'dummy_segment_' || segment AS feature FROM out
    UNION ALL SELECT conversation_id, 'dummy_topic_' || topic FROM out""",
)
def _(t):
    return dummies_long(t.outcomes, ["conversation_id"], ["segment", "topic"])


@query(
    "rsh7_flatten_scores",
    """SELECT vec_id, label AS layer, CAST(i - 1 AS INT) AS cv, embedding[i] AS f1, -embedding[i] AS majority_f1
    FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i)""",
)
def _(t):
    nested = t.embeddings.select(
        "vec_id",
        F.col("label").alias("layer"),
        F.col("embedding").alias("f1"),
        F.transform("embedding", lambda x: -x).alias("majority_f1"),
    )
    return flatten_scores(nested, ["vec_id", "layer"], ["f1", "majority_f1"])
