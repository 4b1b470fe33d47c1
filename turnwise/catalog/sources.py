from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.catalog.registry import query
from turnwise.config import INFERENCE_PROMPT
from turnwise.functions.turns import conversation_text
from turnwise.operators.joins import pending_questions
from turnwise.operators.turns import nest_turns
from turnwise.session import scratch_path
from turnwise.sources.requests import build_requests, request_key, write_requests
from turnwise.sources.stages import load_stage, save_stage
from turnwise.sources.tables import read_csv, read_lexicon, read_responses, read_table


@query(
    "src1_read_table",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
)
def _(t):
    schema = "l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE"
    return read_table(t.spark, f"{t.folder}/lineitem.parquet", schema)


@query("src2_read_csv", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(t):
    path = scratch_path(t.spark, "csv")
    columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    t.orders.select(*columns).write.csv(path, header=True)
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderpriority STRING"
    return read_csv(t.spark, path, schema, ["o_orderkey", "o_orderpriority", "o_totalprice"])


@query(
    "src3_read_lexicon",
    r"""SELECT DISTINCT word, 'concreteness' AS category, length(word) / 8.0::DOUBLE AS weight
    FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM benchmark)""",
)
def _(t):
    path = scratch_path(t.spark, "lexicon")
    found = t.benchmark.select(
        F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("Word")
    ).distinct()
    found.withColumn("Conc.M", F.length("Word") / 8.0).write.csv(path, header=True)
    return read_lexicon(t.spark, path)


@query(
    "src4_read_responses",
    "SELECT event_id AS request, props AS content FROM events",
)
def _(t):
    path = scratch_path(t.spark, "responses")
    message = F.struct(F.struct(F.col("props").alias("content")).alias("message"))
    body = F.struct(F.struct(F.array(message).alias("choices")).alias("body"))
    t.events.select(
        F.concat(F.lit("request-"), "event_id").alias("custom_id"),
        body.alias("response"),
    ).write.json(path)
    return read_responses(t.spark, path).select(
        request_key(F.col("custom_id")).cast("bigint").alias("request"), "content"
    )


_PARTS = INFERENCE_PROMPT.replace("'", "''").split("{conversation}")


@query(
    "src5_write_requests",
    f"""SELECT 'request-' || conv_id AS custom_id, 'answering-model' AS model, 'user' AS role,
      '{_PARTS[0]}' || string_agg(role || ': ' || text, chr(10) ORDER BY turn) || '{_PARTS[1]}' AS content,
      false AS reasoning
    FROM conversations GROUP BY conv_id""",
)
def _(t):
    texts = nest_turns(t.turns).withColumn("conversation_text", conversation_text(F.col("turns")))
    path = scratch_path(t.spark, "requests")
    write_requests(build_requests(texts, "answering-model"), path)
    return t.spark.read.schema(
        "custom_id STRING, body STRUCT<model: STRING, messages: ARRAY<STRUCT<role: STRING, "
        "content: STRING>>, reasoning: STRUCT<enabled: BOOLEAN>>"
    ).json(path).select(
        "custom_id",
        "body.model",
        F.col("body.messages")[0]["role"].alias("role"),
        F.col("body.messages")[0]["content"].alias("content"),
        F.col("body.reasoning.enabled").alias("reasoning"),
    )


@query(
    "src6_stage_round_trip",
    "SELECT o_orderstatus AS model, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1",
)
def _(t):
    path = scratch_path(t.spark, "stage")
    save_stage(t.orders.withColumn("model", F.col("o_orderstatus")), path)
    return load_stage(t.spark, path).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key")
    )


@query("src7_stage_if_absent", "SELECT o_orderkey, o_totalprice FROM orders")
def _(t):
    path = scratch_path(t.spark, "stage")
    prices = t.orders.select("o_orderkey", "o_totalprice")
    save_stage(prices, path, mode="ignore")
    save_stage(prices.withColumn("o_totalprice", F.lit(0.0)), path, mode="ignore")
    return load_stage(t.spark, path)


@query(
    "src8_pending_questions",
    """SELECT item_id AS q_id, text FROM benchmark
    WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""",
)
def _(t):
    questions = t.benchmark.select(F.col("item_id").alias("q_id"), "text")
    answered = t.labels.filter("quality = 0").select(F.col("doc_id").alias("q_id"))
    return pending_questions(questions, answered)
