"""The documents from raw to token files: each stage applies one operator to all rows before it.

All stages but the last return the columns they were given, as they came: columns other than ``doc_id``,
``text``, ``lang`` and ``source`` are carried along under neutral names, so none of them can clash with a
column of an operator. Nulls may stand in any column and an empty table gives an empty one; what a stage
does with null and empty texts, ties and repeated rows is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.budget_mix import mix
from turnwise.llm.catalog import (
    MIX_LEVELS, MIX_SEED, judge_toxicity, token_digests, weight_of, with_domain,
)
from turnwise.llm.common import set_aside, stored, table
from turnwise.llm.decontamination import find_leaks
from turnwise.llm.fragment_join import similar_documents

#: The columns that stages read.
READ = ["doc_id", "text", "lang", "source"]
#: No SQL expresses a fitted classifier; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. Null and empty texts stay; repeated rows go or stay together, and so do
    texts of equal words whatever their ids."""
    docs, restore = set_aside(docs, READ)
    return restore(judge_toxicity(spark, docs, sf_dir).filter(~F.col("toxic")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of documents that share 0.8 of their five-word
    shingles. Rows with the same id and text are one document; one of a group's texts with its smallest id,
    or without any id, stays; those without words all stay."""
    docs, restore = set_aside(docs, READ)
    text_of = F.xxhash64("text")
    found = similar_documents(docs.select("doc_id", "text", text_of.alias("_of")), size=5, percent=80, carried=["_of"])
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    empty = F.when(F.col("root").isNull(), F.col("_of"))
    kept = kept.groupBy(F.col("doc_id").alias("_kept"), "root", empty.alias("_empty")).agg(F.min("_of").alias("_of"))
    same = F.col("doc_id").eqNullSafe(F.col("_kept")) & (text_of == F.col("_of"))
    return restore(docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten benchmark words. Null and empty texts stay. Rows are judged by id and
    text, so another text of the same id, or of none, goes for its own windows alone."""
    docs, restore = set_aside(docs, READ)
    key = {"_hit": F.col("doc_id"), "_of": F.xxhash64("text")}
    rows = docs.select(F.struct(*(c.alias(name) for name, c in key.items())).alias("doc_id"), "text")
    leaks = find_leaks(rows, table(spark, sf_dir, "benchmark"))
    hit = stored(leaks.filter(F.size("hit") > 0).select("doc_id.*").distinct(), "hit")
    same = key["_hit"].eqNullSafe(F.col("_hit")) & (key["_of"] == F.col("_of"))
    return restore(docs.join(hit, same, "left_anti"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all words, by the weights of domains, languages and sources; no document twice.

    Null languages and sources count as empty names. Null and empty texts cost nothing and stay where their
    place in the seeded order lies before the budget's end. Rows of one id share that place."""
    docs, restore = set_aside(docs, READ)
    weights = {level: weight_of(level) for level in MIX_LEVELS}
    mixed = mix(with_domain(docs), MIX_LEVELS, weights, share=(9, 10), epochs=1, seed=MIX_SEED)
    return restore(mixed)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents that are left, described from what the files hold. Null and empty texts
    are their end id alone; rows of one id are in the order of a hash of their texts."""
    return token_digests(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
    ("mixing", mixing), ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
