from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.registry import MARKERS, OUTCOMES, query
from turnwise.config import COLLINEAR_FEATURES
from turnwise.functions.structs import (
    drop_prefixed,
    field_or_default,
    numeric_columns,
    other_columns,
    pick_by_label,
    prefixed,
    select_features,
)
from turnwise.operators.filters import (
    binarize,
    known,
    min_group_size,
    recode,
    text_contains,
    without_outliers,
)
from turnwise.operators.joins import topic_from_prompt

WITH_OUT = f"WITH {OUTCOMES} "


@query(
    "prj1_field_or_default",
    r"""SELECT event_id, CASE WHEN event_type = 'error' THEN -1 WHEN k % 7 = 0 THEN NULL ELSE k END AS k
    FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events)""",
)
def _(t):
    parsed = F.from_json("props", "k INT")
    kept = F.struct(F.when(parsed["k"] % 7 != 0, parsed["k"]).alias("k"))
    nullable = F.when(F.col("event_type") != "error", kept)
    return t.events.select("event_id", nullable.alias("answer")).select(
        "event_id", field_or_default(F.col("answer"), "k", -1).alias("k")
    )


@query(
    "prj2_pick_by_label",
    WITH_OUT
    + """SELECT conversation_id, CASE status WHEN 'F' THEN segment WHEN 'O' THEN region END AS response
    FROM out""",
)
def _(t):
    label = F.concat(F.lit("response_"), F.lower("status"))
    options = {"f": F.col("segment"), "o": F.col("region")}
    return t.outcomes.select("conversation_id", pick_by_label(label, options).alias("response"))


@query(
    "prj3_rename_prefix",
    """SELECT p_partkey, p_size AS user_prompt_liwc_size, p_retailprice AS user_prompt_liwc_price
    FROM part""",
)
def _(t):
    renamed = t.part.select("p_partkey", "p_size", "p_retailprice").withColumnsRenamed(
        {"p_size": "size", "p_retailprice": "price"}
    )
    return prefixed(renamed, "user_prompt_liwc_", except_for=["p_partkey"])


@query("prj4_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(t):
    return t.orders.drop("o_orderdate", "o_orderpriority", "not_a_column")


@query(
    "prj5_select_features",
    "SELECT l_orderkey, l_linenumber, l_quantity AS words_user_prompt, l_tax AS words_model_response FROM lineitem",
)
def _(t):
    renamed = t.lineitem.withColumnsRenamed(
        {"l_quantity": "words_user_prompt", "l_tax": "words_model_response", "l_discount": "q_1"}
    )
    return select_features(
        drop_prefixed(renamed, "q_"), ["user_prompt", "model_response"], ["l_orderkey", "l_linenumber"]
    )


@query(
    "prj6_drop_collinear",
    """SELECT l_orderkey, l_linenumber, l_discount AS perplexity_user_prompt FROM lineitem""",
)
def _(t):
    named = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("num_tokens_user_prompt"),
        F.col("l_discount").alias("perplexity_user_prompt"),
        F.col("l_tax").alias("user_prompt_liwc_socbehav"),
    )
    return named.drop(*COLLINEAR_FEATURES)


@query(
    "prj7_numeric_columns",
    """SELECT c_custkey, c_nationkey, c_acctbal, concat_ws('/', c_name, c_mktsegment) AS others
    FROM customer""",
)
def _(t):
    df = t.customer
    return df.select(*numeric_columns(df), F.concat_ws("/", *other_columns(df)).alias("others"))


@query(
    "prj8_topic_from_prompt",
    "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN text END AS topic FROM conversations WHERE turn = 0",
)
def _(t):
    first = t.conversations.filter("turn = 0")
    flagged = topic_from_prompt(first, F.col("conv_id") % 2 == 0, F.col("text"))
    return flagged.select("conv_id", "turn", "topic")


@query("flt1_equality", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def _(t):
    return t.documents.filter(F.col("lang") == "en").select("doc_id", "source")


@query(
    "flt2_not_null",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS NOT NULL",
)
def _(t):
    nulled = t.orders.withColumn(
        "o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    )
    return nulled.filter(F.col("o_orderpriority").isNotNull()).select("o_orderkey", "o_orderpriority")


@query(
    "flt3_known",
    WITH_OUT
    + """SELECT conversation_id, segment FROM out
    WHERE segment NOT IN ('HOUSEHOLD', 'AFRICA') AND segment <> 'MACHINERY'""",
)
def _(t):
    nulled = t.outcomes.withColumn("segment", F.nullif(F.col("segment"), F.lit("MACHINERY")))
    return known(nulled, "segment", MARKERS).select("conversation_id", "segment")


@query(
    "flt4_membership",
    """SELECT event_type, count(*) AS n FROM events
    WHERE event_type IN ('click', 'view', 'error') AND user_id NOT IN (1, 2, 3) GROUP BY 1""",
)
def _(t):
    kept = t.events.filter(
        F.col("event_type").isin("click", "view", "error") & ~F.col("user_id").isin(1, 2, 3)
    )
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt5_without_outliers",
    WITH_OUT
    + """SELECT conversation_id, nullif(topic, '2-HIGH') AS topic FROM out
    WHERE nullif(topic, '2-HIGH') IS DISTINCT FROM '5-LOW'""",
)
def _(t):
    nulled = t.outcomes.withColumn("topic", F.nullif(F.col("topic"), F.lit("2-HIGH")))
    return without_outliers(nulled, marker="5-LOW").select("conversation_id", "topic")


@query(
    "flt6_complete_rows",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax <> 0 AND l_returnflag <> 'N'",
)
def _(t):
    nulled = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
        F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"),
    )
    return nulled.na.drop().select("l_orderkey", "l_linenumber")


@query(
    "flt7_text_contains",
    "SELECT doc_id FROM documents WHERE contains(text, 'tion') AND regexp_matches(text, '[0-9]+')",
)
def _(t):
    return t.documents.filter(
        text_contains(F.col("text"), "tion") & F.col("text").rlike("[0-9]+")
    ).select("doc_id")


@query(
    "flt8_min_group_size",
    """SELECT event_id, user_id FROM events
    WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 2)""",
)
def _(t):
    return min_group_size(t.events.select("event_id", "user_id"), ["user_id"])


@query(
    "map1_recode",
    WITH_OUT
    + """SELECT conversation_id, CASE topic WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'high'
    WHEN '5-LOW' THEN 'low' ELSE topic END AS topic FROM out""",
)
def _(t):
    mapping = {"1-URGENT": "high", "2-HIGH": "high", "5-LOW": "low"}
    return t.outcomes.select("conversation_id", recode(F.col("topic"), mapping).alias("topic"))


@query(
    "map2_binarize",
    WITH_OUT
    + """SELECT conversation_id, CASE WHEN region = 'EUROPE' THEN 0 ELSE 1 END AS region FROM out
    WHERE region IN ('EUROPE', 'AMERICA', 'ASIA')""",
)
def _(t):
    rules = {"region": (["EUROPE"], ["AMERICA", "ASIA"])}
    return binarize(t.outcomes, "region", rules).select("conversation_id", "region")
