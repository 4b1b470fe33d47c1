"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) of every id of ``links`` (``a``, ``b``).

    Rounds of the large-star and small-star steps, each written to the shared folder, until nothing
    changes; their number grows with the logarithm of the number of ids. Smallest neighbours are
    found by aggregation, so a hub is never gathered in one place.
    """
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).filter("id IS NOT NULL").distinct()
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, before = stored(edges.distinct(), "edges"), None
    while True:
        now = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if now == before or not now["n"]:
            break
        before = now
        edges = stored(_small_star(_large_star(edges)), "edges")
    root = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ids.join(root, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of an id with the smallest of the id and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links an id and its smaller neighbours with the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def spanning(a, b):
    """Of links in two arrays, those that join two groups not joined before; small inputs only."""
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for place, (x, y) in enumerate(zip(a, b)):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(place)
    return kept
