"""URL verdicts from rules and, where no rule fits, from a Bloom filter cascade over hosts.

The first filter of the cascade holds the listed keys, the second those other keys of the universe
that the first one passes by mistake, the third the listed keys that the second passes, and so on
until a level has no mistakes. As the universe is the complete set of the corpus's keys, walking the
levels answers each of them exactly, and no page is joined or shuffled.

Only DataFrame functions are used. Filters are long arrays in chunks, built by bitwise aggregation
and read as a scalar subquery. All levels together are bounded by ``max_bits``; a larger list is
answered by a join on the key, with the same verdicts.

A null or empty key is never listed. Repeated keys count once, and a key is listed if any of its rows
says so (null: no).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import UPPER, stored

BITS_PER_KEY = 10
HASHES = 7
#: Of one level. Ten bits a key, so about 13 million listed keys in 16 MB.
MAX_BITS = 1 << 27
CHUNK_WORDS = 4096


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """The bits that stand for a key. Two 32-bit halves of one hash, so no sum can overflow."""
    digest = F.xxhash64(F.lit(level), key)
    low = digest.bitwiseAND(F.lit(0xFFFFFFFF))
    step = F.shiftrightunsigned(digest, 32).bitwiseOR(F.lit(1))
    return [(low + i * step) % bits for i in range(HASHES)]


def _build(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with the filter's words, in chunks."""
    spark = keys.sparkSession
    place = F.explode(F.array(*_places(F.col("key"), level, bits)))
    set_bits = keys.select(place.alias("place")).select(
        (F.col("place") / 64).cast("bigint").alias("word"),
        F.expr("shiftleft(1L, int(place % 64))").alias("bits"),
    )
    empty = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = set_bits.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunks = words.groupBy((F.col("word") / CHUNK_WORDS).cast("bigint").alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("words")
    )
    return chunks.agg(F.array_sort(F.collect_list(F.struct("chunk", "words")))["words"].alias("words"))


@dataclass
class Cascade:
    """The levels, as tables of one row, or the listed keys where they are too many."""

    levels: list[tuple[DataFrame, int]]
    listed: DataFrame | None = None

    def _passes(self, key: Column, level: int) -> Column:
        words, bits = self.levels[level - 1]
        filter_words = words.scalar()
        found = F.lit(True)
        for place in _places(key, level, bits):
            chunk = F.get(filter_words, (place / (64 * CHUNK_WORDS)).cast("int"))
            word = F.get(chunk, ((place / 64).cast("bigint") % CHUNK_WORDS).cast("int"))
            bit = F.call_function("shiftrightunsigned", word, (place % 64).cast("int"))
            found = found & (bit.bitwiseAND(F.lit(1)) == 1)
        return found

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels), 0, -1):
            answer = F.when(self._passes(key, level), answer).otherwise(level % 2 == 0)
        return F.coalesce((key != "") & answer, F.lit(False))

    def mark(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a column that tells whether its key is listed."""
        if self.listed is None:
            return df.withColumn(name, self.contains(key))
        listed = self.listed.withColumnRenamed("key", f"_{name}_key")
        joined = df.join(listed, key == F.col(f"_{name}_key"), "left")
        return joined.withColumn(name, F.col(f"_{name}_key").isNotNull()).drop(f"_{name}_key")


def build_cascade(
    universe: DataFrame, key: str, listed: str, max_bits: int = MAX_BITS,
) -> Cascade:
    """``universe``: rows of every key of the corpus, and whether the key is listed."""
    keys = universe.select(F.col(key).alias("key"), F.coalesce(F.col(listed), F.lit(False)).alias("listed"))
    keys = stored(
        keys.filter(F.col("key") != "").groupBy("key").agg(F.bool_or("listed").alias("listed")), "keys"
    )
    inside = keys.filter("listed").select("key")
    outside = keys.filter(~F.col("listed")).select("key")
    held, levels, n = inside, [], inside.count()
    while n:
        bits = max(64, -(-n * BITS_PER_KEY // 64) * 64)
        if bits > max_bits:
            return Cascade([], inside)
        level = len(levels) + 1
        levels.append((stored(_build(held, level, bits), "level"), bits))
        passed = outside.filter(Cascade(levels)._passes(F.col("key"), level))
        held, outside = stored(passed, "passed"), held
        n = held.count()
    return Cascade(levels)


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], cascade: Cascade,
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of each page, one row for each row.

    ``rules``: (verdict, host, path). A rule fits its host and all subdomains, if the url's path
    starts with the rule's; the longest one wins. Where none fits, listed hosts are blocked. A null
    url, or one without ``://``, has an empty host and path and is allowed.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        ((host == of) | host.endswith("." + of)) & path.startswith(start) for _, of, start in by_length
    ]
    rule = F.coalesce(*(F.when(fit, of + start) for fit, (_, of, start) in zip(fits, by_length)))
    ruled = F.coalesce(*(F.when(fit, verdict) for fit, (verdict, _, _) in zip(fits, by_length)))
    rows = cascade.mark(rows, host, "_listed").withColumn("rule", rule)
    verdict = F.coalesce(ruled, F.when(F.col("_listed"), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
