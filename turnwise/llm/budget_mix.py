"""Mixing a corpus to target weights by budgets down a tree, such as domain, language, source.

The token budget of a node goes to its children by their weights. What a child cannot use (its
tokens times ``epochs``) goes to its siblings by theirs, and only what a whole family cannot use
goes up, as every family takes no more than it can hold. A leaf reads its documents in full epochs
and then a prefix of one more, each in an order seeded by the epoch.

Only DataFrame functions are used. The tree is as small as its leaves; documents meet it in one join,
whose small side Spark broadcasts by its stored size. The prefix of a leaf is found from sums over
ranges of the order's hash, and only the one range in which the budget ends is ordered, so a source
with a third of all rows is no task of its own.

Null path columns count as the empty name, null texts have no tokens. Rows with the same document id
are read at the same place of an epoch. A weight of null or below zero counts as 0 and gets nothing; what
lies below it is no capacity of the nodes above.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import WORD, set_aside, stored

#: Documents that a range of the order holds on average; its number of ranges follows from it.
RANGE_DOCS = 4000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _big(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def allocate(leaves: DataFrame, levels: list[str], weights: Mapping[str, Column], budget: Column) -> DataFrame:
    """``leaves`` (level columns, ``capacity``) with the ``tokens`` that each may use.

    At each node the children are taken by capacity for each unit of weight; those that their share
    fills are the first ones. Shares are rounded down.
    """
    given = leaves.agg(_big(budget).alias("given"))
    weight_of = {c: _big(F.greatest(F.coalesce(weights[c], F.lit(0)), F.lit(0))) for c in levels}
    for depth, level in enumerate(levels):
        path, parents = levels[: depth + 1], levels[:depth]
        usable = F.lit(True)
        for below in levels[depth + 1 :]:
            usable = usable & (weight_of[below] > 0)
        capacity = F.when(usable, F.col("capacity")).otherwise(0)
        nodes = leaves.groupBy(*path).agg(_big(F.sum(capacity)).alias("capacity"))
        nodes = nodes.withColumn("weight", weight_of[level])
        nodes = nodes.join(given, parents) if parents else nodes.withColumn("given", given.scalar())
        ratio = F.when(F.col("weight") > 0, F.col("capacity").cast("double") / F.col("weight").cast("double"))
        family = Window.partitionBy(*(parents or [F.lit(0)]))
        in_order = family.orderBy(ratio.asc_nulls_last(), level)
        earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
        later = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumn("_before", F.coalesce(F.sum("capacity").over(earlier), F.lit(0)))
        nodes = nodes.withColumn("_weights", F.sum("weight").over(later))
        nodes = nodes.withColumn(
            "_full",
            (F.col("weight") > 0) & (
                _big(_big(F.col("capacity")) * _big(F.col("_weights")))
                <= _big(F.col("weight") * _big(F.col("given") - F.col("_before")))
            ),
        )
        used = F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(family)
        open_weight = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(family)
        nodes = nodes.withColumn("_used", _big(used)).withColumn("_open", _big(open_weight))
        share = F.expr("cast((weight * cast(given - _used as decimal(38,0))) div _open as decimal(38,0))")
        given = nodes.select(
            *path,
            F.when(F.col("_full"), F.col("capacity"))
            .when((F.col("_open") > 0) & (F.col("weight") > 0), share)
            .otherwise(_big(F.lit(0))).alias("given"),
        )
    return given.withColumnRenamed("given", "tokens")


def draw_order(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a document in an epoch, as a text that sorts."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")))


def mix(
    docs: DataFrame, levels: list[str], weights: Mapping[str, Column], share: tuple[int, int] = (1, 2),
    epochs: int = 1, seed: int = 0,
) -> DataFrame:
    """``docs`` with ``_tokens``, ``_epoch`` and ``_taken``: a row for each epoch that reads the document.

    ``share`` is the budget as a fraction of all tokens, in two integers. ``weights`` has an integer
    column of the path for each level. The last document of a leaf's prefix is taken whole as a row;
    ``_taken`` says how many of its tokens the budget still holds. Columns of ``docs`` with these three names
    give way to them; all others stay as they are.
    """
    docs, restore = set_aside(docs, ["doc_id", "text", *levels])
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    counts = stored(docs.select("doc_id", *named, count_words(F.col("text")).alias("n")), "counts")
    leaves = stored(
        counts.groupBy(*levels).agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
        .withColumn("capacity", _big(F.col("n")) * epochs),
        "leaves",
    )
    budget = F.expr(f"(cast(sum(n) as decimal(38,0)) * {share[0]}) div {share[1]}")
    given = allocate(leaves, levels, weights, budget)
    plan = leaves.join(given, levels).select(
        *levels,
        F.when(F.col("n") > 0, F.expr("tokens div n")).otherwise(0).alias("full"),
        F.when(F.col("n") > 0, F.expr("cast(tokens - cast(n as decimal(38,0)) * (tokens div n) as bigint)"))
        .otherwise(0).alias("rest"),
    )
    plan = stored(plan, "plan")
    largest = leaves.agg(F.max("docs").alias("docs")).first()["docs"] or 0
    digits = max(1, (max(1, largest // RANGE_DOCS).bit_length() + 3) // 4)

    placed = counts.join(plan, levels).filter("rest > 0")
    placed = placed.withColumn("at", draw_order(seed, F.col("full"), F.col("doc_id")))
    placed = placed.withColumn("range", F.substring("at", 1, digits))
    sums = placed.groupBy(*levels, "range").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    ranges = Window.partitionBy(*levels).orderBy("range")
    before = F.sum("n").over(ranges) - F.col("n")
    cut = sums.withColumn("before", before).filter("before < rest and before + n >= rest")
    cut = stored(cut.select(*levels, "range", "before"), "cut")
    # In the range where the budget ends, the last document that begins within it.
    within = Window.partitionBy(*levels).orderBy("at")
    last = placed.join(cut, [*levels, "range"]).groupBy(*levels, "at").agg(
        F.sum("n").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before")
    )
    last = last.withColumn("before", F.col("before") + F.sum("n").over(within) - F.col("n"))
    last = last.filter("before < rest").groupBy(*levels).agg(
        F.max("at").alias("last"), F.max("before").alias("before")
    )
    ends = stored(
        plan.join(last, levels, "left").select(
            *(F.col(c).alias(f"_at_{c}") for c in levels), F.col("full").alias("_full"),
            F.col("rest").alias("_rest"), F.col("last").alias("_last"), F.col("before").alias("_before"),
        ),
        "ends",
    )
    on = [F.coalesce(docs[c].cast("string"), F.lit("")) == F.col(f"_at_{c}") for c in levels]
    rows = docs.join(ends, on).withColumn("_tokens", count_words(F.col("text")))
    rows = rows.withColumn("_order", draw_order(seed, F.col("_full"), F.col("doc_id")))
    times = F.col("_full") + F.when(F.col("_order") <= F.col("_last"), 1).otherwise(0)
    rows = rows.withColumn(
        "_epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("bigint"), times - 1)))
    )
    partial = (F.col("_epoch") == F.col("_full")) & (F.col("_order") == F.col("_last"))
    taken = F.when(partial, F.least("_tokens", F.col("_rest") - F.col("_before"))).otherwise(F.col("_tokens"))
    return restore(rows.withColumn("_taken", taken), "_tokens", "_epoch", "_taken")
