from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.registry import OUTCOMES, query
from turnwise.operators.aggregates import conversation_means
from turnwise.operators.joins import (
    attach_survey,
    attach_topics,
    cross_prompts,
    label_by_key,
    pending_questions,
)
from turnwise.operators.pairs import pair_table
from turnwise.operators.probe import representations_of
from turnwise.sources.tables import spread


@query(
    "jn1_attach_survey",
    """SELECT o_orderkey, o_custkey AS user_id, c_mktsegment, c_acctbal FROM orders
    JOIN customer ON o_custkey = c_custkey""",
)
def _(t):
    facts = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"))
    survey = t.customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_acctbal")
    return attach_survey(facts, survey)


@query(
    "jn2_join_and_drop_key",
    "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def _(t):
    named = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    return t.nation.join(named, "n_regionkey").drop("n_regionkey").select("n_name", "r_name")


@query(
    "jn3_attach_topics",
    """SELECT o_orderkey AS conversation_id, o_totalprice, n_name AS topic FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    facts = t.orders.select(F.col("o_orderkey").alias("conversation_id"), "o_totalprice")
    topic_of = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("cluster_id")
    )
    names = t.nation.select(
        F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("gpt_description")
    )
    return attach_topics(facts, topic_of, names)


@query(
    "jn4_outcome_with_features",
    f"""WITH {OUTCOMES} SELECT conversation_id, topic, outcome, round(avg(l_quantity), 6) AS quantity,
      round(avg(l_discount), 8) AS discount
    FROM out JOIN lineitem ON conversation_id = l_orderkey GROUP BY 1, 2, 3""",
)
def _(t):
    features = conversation_means(
        t.lineitem.withColumnRenamed("l_orderkey", "conversation_id"),
        ["conversation_id"],
        ["l_quantity", "l_discount"],
    )
    outcome = t.outcomes.select("conversation_id", "topic", "outcome")
    return outcome.join(features, "conversation_id").select(
        "conversation_id",
        "topic",
        "outcome",
        F.round("l_quantity", 6).alias("quantity"),
        F.round("l_discount", 8).alias("discount"),
    )


@query(
    "jn5_cross_prompts",
    """SELECT conv_id AS conversation_id, turn, item_id AS q_id, CAST(length(text_b) AS INT) AS n_chars
    FROM conversations, (SELECT item_id, text AS text_b FROM benchmark)""",
)
def _(t):
    conversations = t.turns.select("conversation_id", "turn")
    questions = t.benchmark.select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))
    return cross_prompts(conversations, questions).select(
        "conversation_id", "turn", "q_id", F.length("question").alias("n_chars")
    )


@query(
    "jn6_pending_by_condition",
    """SELECT DISTINCT o_orderpriority AS condition, o_custkey AS q_id FROM orders
    WHERE (o_orderpriority, o_custkey) NOT IN
      (SELECT (o_orderpriority, o_custkey) FROM orders WHERE o_orderstatus = 'F')""",
)
def _(t):
    orders = t.orders.select(
        F.col("o_orderpriority").alias("condition"), F.col("o_custkey").alias("q_id"), "o_orderstatus"
    )
    keys = ["condition", "q_id"]
    asked = orders.select(*keys).distinct()
    return pending_questions(asked, orders.filter("o_orderstatus = 'F'"), keys)


@query(
    "jn7_representations_of",
    """SELECT vec_id, label, CAST(len(embedding) AS INT) AS size FROM embeddings
    WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def _(t):
    rows = t.labels.filter("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return representations_of(t.embeddings, rows, "vec_id").select(
        "vec_id", "label", F.size("embedding").alias("size")
    )


@query(
    "jn8_columns_by_key",
    """SELECT c.conv_id, c.turn, CAST(length(c.text) AS INT) AS n_chars, CAST(d.n AS INT) AS n_tokens FROM conversations c
    JOIN (SELECT conv_id, turn, len(string_split(text, ' ')) AS n FROM conversations) d
    ON c.conv_id = d.conv_id AND c.turn = d.turn""",
)
def _(t):
    keys = ["conv_id", "turn"]
    left = t.conversations.select(*keys, F.length("text").alias("n_chars"))
    right = t.conversations.select(*keys, F.size(F.split("text", " ")).alias("n_tokens"))
    return left.join(right, keys)


@query(
    "jn9_lookup",
    """SELECT l_orderkey, l_linenumber, p_brand FROM lineitem
    LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""",
)
def _(t):
    lookup = t.part.filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return t.lineitem.join(lookup, "l_partkey", "left").select("l_orderkey", "l_linenumber", "p_brand")


@query(
    "jn10_label_by_key",
    """SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))
      THEN 'yes' ELSE 'no' END AS correct_answer FROM documents d""",
)
def _(t):
    questions = spread(t.documents.select("doc_id", F.col("text").alias("question")))
    keys = t.benchmark.select(F.col("text").alias("key"))
    return label_by_key(questions, keys).select("doc_id", "correct_answer")


@query(
    "jn11_pair_differences",
    """WITH c AS (
      SELECT c_custkey, c_mktsegment AS segment, r_name AS region, n_name AS topic, c_acctbal AS x
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    long AS (
      SELECT 'segment' AS demo, segment AS grp, topic, x FROM c
      UNION ALL SELECT 'region', region, topic, x FROM c),
    pairs AS (
      SELECT CASE WHEN a.grp = b.grp THEN 'same_group_' ELSE 'diff_group_' END ||
             CASE WHEN a.topic = b.topic THEN 'same_topic' ELSE 'diff_topic' END AS cell,
             abs(a.x - b.x) AS d
      FROM long a JOIN long b ON a.demo = b.demo)
    SELECT cell, CAST(count(*) AS DECIMAL(38,0)) AS n, round(avg(d), 5) AS mean, round(stddev_samp(d), 5) AS sd
    FROM pairs GROUP BY 1""",
)
def _(t):
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    users = t.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("topic"),
        F.col("c_acctbal").alias("outcome"),
    )
    cells = pair_table(users, ["segment", "region"], "topic", "outcome")
    return cells.select("cell", "n", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))
