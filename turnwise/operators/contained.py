"""Whether any of many strings occurs in a text: one automaton of all strings, run once over each text.

The automaton (Aho-Corasick) takes time linear in the text, however many strings there are. Strings beyond
SHARD_CHARS are dealt by hash to shards of about half that size; one shard after another is brought to
the driver and sent out, and texts that hold none of its strings are tested against the next. Texts
are never exchanged; only with more than one shard are the rows written between them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.session import cut_lineage

#: Characters of strings that one automaton holds; a worker needs some fifty bytes for each.
SHARD_CHARS = 1 << 21

#: The automaton a worker process has built, by the token of its shard.
_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(token: str, strings) -> ahocorasick.Automaton:
    """Built once in a worker process, as long as Spark reuses it."""
    if token not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for string in strings.value:
            built.add_word(string)
        built.make_automaton()
        _BUILT[token] = built
    return _BUILT[token]


def _finder(strings: list[str], spark) -> Callable[[Column], Column]:
    shipped = spark.sparkContext.broadcast(strings)
    token = uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        automaton = _automaton(token, shipped)
        if not len(automaton):
            return pa.array([False] * len(texts), pa.bool_())
        found = (None if t is None else next(automaton.iter(t), None) is not None for t in texts.to_pylist())
        return pa.array(found, pa.bool_())

    return holds


def contains_any(df: DataFrame, text: str, strings: DataFrame, into: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``df`` with a column that tells whether the text holds any of the strings (the first column of
    ``strings``). A null text holds none, null strings are none, and every text holds the empty string."""
    spark = df.sparkSession
    strings = strings.select(F.col(strings.columns[0]).alias("s")).filter(F.col("s").isNotNull()).distinct()
    total, empty = strings.agg(F.coalesce(F.sum(F.length("s") + 1), F.lit(0)), F.coalesce(F.bool_or(F.col("s") == ""), F.lit(False))).first()
    if empty:
        return df.withColumn(into, F.col(text).isNotNull())
    shards = 1 if total <= shard_chars else -(-2 * total // shard_chars)
    marked = df.withColumn(into, F.lit(False))
    if shards > 1:
        strings = cut_lineage(strings)
    for shard in range(shards):
        own = strings.filter(F.pmod(F.xxhash64("s"), F.lit(shards)) == shard)
        holds = _finder([row[0] for row in own.collect()], spark)
        untested = F.when(~F.col(into), F.col(text)) if shard else F.col(text)
        marked = marked.withColumn(into, F.col(into) | F.coalesce(holds(untested), F.lit(False)))
        if shard + 1 < shards:
            marked = cut_lineage(marked)
    return marked
