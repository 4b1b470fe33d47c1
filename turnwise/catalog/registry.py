"""Registration of queries and the views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder, read when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    @property
    def outcomes(self) -> DataFrame:
        """One row per order, read as a conversation: user, three demographics, topic, outcome."""
        place = self.nation.join(
            self.region, F.col("n_regionkey") == F.col("r_regionkey")
        ).select("n_nationkey", "r_name")
        users = self.customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", "c_mktsegment", "r_name"
        )
        return self.orders.join(users, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("conversation_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("status"),
            F.col("c_mktsegment").alias("segment"),
            F.col("r_name").alias("region"),
            F.col("o_orderpriority").alias("topic"),
            F.col("o_totalprice").alias("outcome"),
        )

    @property
    def turns(self) -> DataFrame:
        """Conversation turns under the names the operators use."""
        return self.conversations.select(
            F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content")
        )


# The same view in SQL.
OUTCOMES = """out AS (
  SELECT o_orderkey AS conversation_id, o_custkey AS user_id, o_orderstatus AS status,
         c_mktsegment AS segment, r_name AS region, o_orderpriority AS topic,
         o_totalprice AS outcome
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

DEMOGRAPHICS = ["segment", "region", "status"]
MARKERS = ["HOUSEHOLD", "AFRICA"]

# One row per conversation and demographic, markers removed.
LONG = OUTCOMES + """, long AS (
  SELECT conversation_id, topic, outcome, demo, grp FROM (
    SELECT conversation_id, topic, outcome, 'segment' AS demo, segment AS grp FROM out
    UNION ALL SELECT conversation_id, topic, outcome, 'region', region FROM out
    UNION ALL SELECT conversation_id, topic, outcome, 'status', status FROM out)
  WHERE grp IS NOT NULL AND grp NOT IN ('HOUSEHOLD', 'AFRICA'))"""


def query(name: str, sql: str | None = None):
    """Register a function of the tables under a name; without SQL only its rows are checked."""

    def register(function: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def rounded(*columns: str, digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(c) for c in columns]


def sql_hash_mod(key: str, seed: int | str, k: int | str) -> str:
    """The seeded draw of ``functions.sampling.hash_mod`` in SQL."""
    return f"(CAST('0x' || left(md5(concat_ws('#', CAST({key} AS VARCHAR), '{seed}')), 8) AS BIGINT) % {k})"
