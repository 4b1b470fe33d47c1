"""Benchmark decontamination by a hash set of the benchmark's word windows.

Texts are lower-cased (A-Z) and cut into words. A window is ``size`` consecutive words of an item; an
item of fewer words, but not none, is one window. The hashes of all windows travel to every task as a
set; each task looks up the window at every word of its texts, and the few that hit are held against
the windows' words by a join before they count. Texts are read once and never shuffled.

The set is written into the plan up to ``max_set`` windows (a benchmark is a fixed small table; the
count is checked). Beyond it the documents' window hashes are joined to the benchmark's instead, and
the rows are the same.

Only DataFrame functions are used. Null and empty texts have no words and no hits. Repeated items and
documents are reported each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import UPPER, stored

SIZE = 10
MAX_SET = 200_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. ``lower`` does just that where no other capital occurs."""
    other = F.regexp_like(text, F.lit(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"))
    return F.when(other, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAK, -1), "")


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """``item_id``, ``n`` (words of the window), ``first`` (its first word's hash), ``words`` and ``hash``."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    cut = items.select("item_id", "w", starts.alias("at"))
    cut = cut.select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("w"))
    return cut.select(
        "item_id", F.size("w").alias("n"), F.xxhash64(F.get("w", F.lit(0))).alias("first"),
        F.array_join("w", " ").alias("words"), F.xxhash64("w").alias("hash"),
    ).distinct()


def _window(words: Column, at: Column, n: int) -> Column:
    return F.slice(words, at + 1, F.lit(n))


def _hits(n: int, firsts: list[int], hashes: list[int]) -> Column:
    """Places (from 0) in ``_words`` whose window of ``n`` words has a hash of the set. The hash of its
    first word is looked up before, as it is cheaper."""
    listed = lambda values: ", ".join(f"{v}L" for v in values)
    return F.expr(
        f"filter(if(size(_words) >= {n}, sequence(0, size(_words) - {n}), cast(array() as array<int>)), at ->"
        f" xxhash64(get(_words, at)) IN ({listed(firsts)})"
        f" AND xxhash64(slice(_words, at + 1, {n})) IN ({listed(hashes)}))"
    )


def _described(words: Column, n: int, places: Column) -> Column:
    return F.transform(
        places,
        lambda at: F.struct(
            at.alias("at"), F.lit(n).alias("n"), F.array_join(_window(words, at, n), " ").alias("words")
        ),
    )


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_set: int = MAX_SET) -> DataFrame:
    """One row for each document: ``_row``, ``doc_id``, ``n_words``, ``hit`` (places of hit words) and
    ``items`` (ids of the items with occurring windows, as sorted strings).

    ``_row`` numbers the rows of the stored scan.
    """
    windows = stored(benchmark_windows(benchmark, size), "windows")
    base = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    known = windows.select("n", "first", "hash").distinct()
    sizes = [r["n"] for r in known.select("n").distinct().orderBy("n").collect()]  # ``size`` at most
    empty = F.array().cast("array<struct<at:int,n:int,words:string>>")
    words = F.col("_words")
    if known.count() <= max_set:
        found = empty
        rows = known.collect()
        for n in sizes:
            firsts = sorted({r["first"] for r in rows if r["n"] == n})
            hashes = sorted({r["hash"] for r in rows if r["n"] == n})
            found = F.concat(found, _described(words, n, _hits(n, firsts, hashes)))
        scanned = base.select("doc_id", F.size("_words").cast("bigint").alias("n_words"), found.alias("found"))
    else:
        scanned = _joined_scan(base, windows, sizes, empty)
    scanned = stored(scanned.withColumn("_row", F.monotonically_increasing_id()), "leaks")
    # A set of window texts is looked up once, however many documents hold the same passage.
    held = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["words"])))
    hit = scanned.filter(F.size("found") > 0).withColumn("_set", held)
    hit = hit.withColumn("_key", F.sha2(F.array_join("_set", "\n"), 256))
    sets = hit.groupBy("_key").agg(F.first("_set").alias("_set"))
    single = sets.select("_key", F.explode("_set").alias("words"))
    met = single.join(windows.select("words", "item_id"), "words").groupBy("_key").agg(
        F.collect_set(F.col("item_id").cast("string")).alias("items"), F.collect_set("words").alias("true")
    )
    true = hit.join(met, "_key").select(
        "_row", F.array_sort("items").alias("items"),
        F.filter("found", lambda f: F.array_contains(F.col("true"), f["words"])).alias("true"),
    )
    spread = F.flatten(F.transform("true", lambda f: F.sequence(f["at"], f["at"] + f["n"] - 1)))
    true = true.select("_row", "items", F.array_sort(F.array_distinct(spread)).alias("hit"))
    return scanned.select("_row", "doc_id", "n_words").join(true, "_row", "left").select(
        "_row", "doc_id", "n_words",
        F.coalesce("hit", F.array().cast("array<int>")).alias("hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _joined_scan(base: DataFrame, windows: DataFrame, sizes: list[int], empty: Column) -> DataFrame:
    """The same scan for a benchmark too large for a set: window hashes are joined. A place travels as its
    number and hash; the words of a document are not copied for each."""
    numbered = stored(base.withColumn("_id", F.monotonically_increasing_id()), "words")
    known = windows.select("n", "hash", "words").distinct()
    parts = []
    for n in sizes:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size("_words") - n),
            lambda at: F.struct(at.alias("at"), F.lit(n).alias("n"), F.xxhash64(_window(F.col("_words"), at, n)).alias("hash")),
        )
        parts.append(numbered.filter(F.size("_words") >= n).select("_id", F.inline(hashes)))
    hashed = parts[0]
    for part in parts[1:]:
        hashed = hashed.unionByName(part)
    found = hashed.join(known, ["n", "hash"]).groupBy("_id").agg(
        F.collect_list(F.struct("at", "n", "words")).alias("found")
    )
    return numbered.join(found, "_id", "left").select(
        "doc_id", F.size("_words").cast("bigint").alias("n_words"), F.coalesce("found", empty).alias("found")
    )


def remove_spans(text: Column, hit: Column) -> Column:
    """The text without its hit words, each with the break after it; ``hit`` as of ``find_leaks``."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    breaks = F.split(text, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", -1)
    kept = F.transform(
        F.sequence(F.lit(0), F.size(words)),
        lambda i: F.when(
            i == 0, F.get(breaks, F.lit(0))
        ).otherwise(F.concat(
            F.when(F.array_contains(hit, i - 1), "").otherwise(F.get(words, i - 1)),
            F.when(F.array_contains(hit, i - 1), "").otherwise(F.get(breaks, i)),
        )),
    )
    return F.when(F.size(hit) > 0, F.array_join(kept, "")).otherwise(text)
