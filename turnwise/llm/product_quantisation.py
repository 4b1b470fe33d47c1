"""Embedding near-dedup by product quantisation.

Unit vectors go to coarse inverted lists; what is left after the list's centre is coded by a short
codebook in each of several subspaces. A vector looks into every list that can hold a neighbour, sums
distances from lookup tables over the codes there, and ranks exactly, by cosine in double precision,
those codes that can be near enough.

Both steps lose nothing. A list is probed unless the plane between its centre and the nearest one is
further away than the threshold's radius, and a code is dropped only if its table distance exceeds the
radius by more than its vector's own coding error, which is stored beside it. So recall is 1 for any
fit, and the centres and codebooks are fitted on a bounded sample (``SAMPLE`` vectors, the first by
hash).

Equal vectors of a label are one class from the start. Lists are compared in tiles of at most
``TILE`` codes and ``TILE`` queries, so a list with a third of all vectors is many tasks. A tile
returns how many vectors each query links with, and of the links only spanning ones.

Vectors link only within a label. Null labels and vectors that are null, empty, zero or hold null or
non-finite components link with nothing. Vectors of another length than the sample's first share one
list without codes. Rows with the same id count each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import stored
from turnwise.llm.components import components, spanning

SAMPLE = 8192
LISTS = 64
SUBSPACES = 8
CODES = 64
ROUNDS = 8
TILE = 1024
SLACK = 1e-6
#: The list of vectors that have no codes.
NO_LIST = -1


def fit_centres(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centres of a bounded sample by Lloyd's rounds from random points."""
    k = min(k, len(points))
    centres = points[np.random.default_rng(seed).choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        n = np.bincount(own, minlength=k)
        for axis in range(points.shape[1]):
            total = np.bincount(own, points[:, axis], k)
            centres[n > 0, axis] = total[n > 0] / n[n > 0]
    return centres


def _squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]
    return np.maximum(out, 0)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return _squared(points, centres).argmin(axis=1)


@dataclass
class Quantiser:
    centres: np.ndarray  # (lists, length)
    parts: list[np.ndarray]  # the axes of each subspace
    books: list[np.ndarray]  # (codes, axes) of each subspace

    @classmethod
    def fit(cls, units: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES) -> Quantiser:
        centres = fit_centres(units, lists)
        rest = units - centres[_nearest(units, centres)]
        parts = np.array_split(np.arange(units.shape[1]), min(subspaces, units.shape[1]))
        return cls(centres, parts, [fit_centres(rest[:, p], codes, seed=i + 1) for i, p in enumerate(parts)])

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and how far each vector is from what they stand for."""
        codes = np.stack([_nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], axis=1)
        back = np.zeros_like(rest)
        for place, (p, b) in enumerate(zip(self.parts, self.books)):
            back[:, p] = b[codes[:, place]]
        return codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(axis=1))

    def probes(self, units: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list, and a mask of the lists that can hold vectors within the radius."""
        distance = _squared(units, self.centres)
        own = distance.argmin(axis=1)
        between = np.sqrt(_squared(self.centres, self.centres))
        excess = distance - distance[np.arange(len(units)), own][:, None]
        return own, excess <= 2 * (radius + SLACK) * between[own] + SLACK

    def distances(self, queries: np.ndarray, codes: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of queries to the codes of one list, from a lookup table per subspace."""
        rest = queries - self.centres[which]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for place, (p, b) in enumerate(zip(self.parts, self.books)):
            total += _squared(rest[:, p], b).astype(np.float32)[:, codes[:, place]]
        return total


def _values(vector: bytes) -> np.ndarray:
    """A stored vector: its components' size in bytes, then the components."""
    return np.frombuffer(vector, f"<f{vector[0]}", offset=1).astype(np.float64)


def _units(vectors: list[bytes]) -> np.ndarray:
    values = np.stack([_values(v) for v in vectors])
    return values / np.sqrt((values**2).sum(axis=1))[:, None]


def _described(vectors: DataFrame) -> DataFrame:
    schema = "vec_id bigint, label string, class bigint, vector binary"

    def describe(batches):
        for batch in batches:
            classes, kept = [], []
            for label, row in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist()):
                vector = None
                if label is not None and row and None not in row:
                    values = np.asarray(row, np.float64)
                    largest = np.abs(values).max()
                    if np.isfinite(largest) and largest > 0:
                        if not 1e-100 < largest < 1e100:  # squares stay in range, the direction is the same
                            values = values / largest
                        single = values.astype("<f4")  # half the bytes where nothing is lost
                        exact = single if (single == values).all() else values.astype("<f8")
                        vector = bytes([exact.itemsize]) + exact.tobytes()
                kept.append(vector)
                digest = None if vector is None else xxhash.xxh3_64_intdigest(vector + label.encode())
                classes.append(None if vector is None else digest - (1 << 63))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(classes, pa.int64()), pa.array(kept, pa.binary())],
                names=["vec_id", "label", "class", "vector"],
            )

    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return stored(rows.mapInArrow(describe, schema), "vectors")


MEMBERS = "label string, length int, list int, class bigint, n bigint, vector binary, codes binary, error double, probes array<int>"


def _listed(classes: DataFrame, quantiser: Quantiser | None, radius: float) -> DataFrame:
    """MEMBERS of every class."""
    length = quantiser.centres.shape[1] if quantiser else 0

    def place(batches):
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            lengths = np.array([len(v) // v[0] for v in vectors], np.int64)
            lists, codes = np.full(len(vectors), NO_LIST), [b""] * len(vectors)
            errors, probes = np.zeros(len(vectors)), [[NO_LIST] for _ in vectors]
            at = np.flatnonzero(lengths == length)
            if len(at):
                units = _units([vectors[i] for i in at])
                own, open_lists = quantiser.probes(units, radius)
                coded, error = quantiser.encode(units - quantiser.centres[own])
                lists[at], errors[at] = own, error
                for row, i in enumerate(at.tolist()):
                    codes[i], probes[i] = coded[row].tobytes(), np.flatnonzero(open_lists[row]).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("label"), pa.array(lengths, pa.int32()), pa.array(lists, pa.int32()), batch.column("class"),
                    batch.column("n"), batch.column("vector"), pa.array(codes, pa.binary()), pa.array(errors),
                    pa.array(probes, pa.list_(pa.int32())),
                ],
                names=[c.split(" ")[0] for c in MEMBERS.split(", ")],
            )

    return stored(classes.select("label", "class", "n", "vector").mapInArrow(place, MEMBERS), "members")


def _parts_of(rows: DataFrame, name: str) -> DataFrame:
    keys = ["label", "length", "list"]
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))


def link_vectors(classes: DataFrame, quantiser: Quantiser | None, cosine: float) -> DataFrame:
    """Rows of ``class`` with ``links`` (vectors it links with, from one tile), and of spanning links
    ``class``, ``other``."""
    radius = float(np.sqrt(2 - 2 * cosine))
    members = _listed(classes, quantiser, radius)
    keys = ["label", "length", "list"]
    queries = members.select("label", "length", F.explode("probes").alias("list"), "class", "vector")
    parts = stored(_parts_of(members, "parts").join(_parts_of(queries, "query_parts"), keys), "parts")
    salt = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(parts, keys).withColumn("part", salt("parts")).withColumn("query_part", every("query_parts"))
    right = queries.join(parts, keys).withColumn("query_part", salt("query_parts")).withColumn("part", every("parts"))
    tile = [*keys, "part", "query_part"]
    left = left.select(*(F.col(c).alias(c) for c in (*tile, "class", "n", "vector", "codes", "error")))
    right = right.select(*(F.col(c).alias(c) for c in (*tile, "class", "vector")))

    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])
        if not held.num_rows or not asked.num_rows:
            return schema.empty_table()
        to, of = held.column("class").to_numpy(), asked.column("class").to_numpy()
        units, queries = _units(held.column("vector").to_pylist()), _units(asked.column("vector").to_pylist())
        which = held.column("list")[0].as_py()
        near = np.ones((len(of), len(to)), bool)
        if which != NO_LIST:
            codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(to), -1)
            reach = radius + held.column("error").to_numpy() + 1e-3  # tables are single precision
            near = quantiser.distances(queries, codes, which) <= (reach**2)[None, :]
        near &= of[:, None] != to[None, :]
        at, with_ = np.nonzero(near)
        exact = np.concatenate([
            np.einsum("ij,ij->i", queries[at[i : i + 65536]], units[with_[i : i + 65536]]) for i in range(0, len(at), 65536)
        ]) if len(at) else np.zeros(0)
        at, with_ = at[exact >= cosine], with_[exact >= cosine]
        links = np.bincount(at, held.column("n").to_numpy()[with_], len(of)).astype(np.int64)
        a, b = of[at], to[with_]
        kept = spanning(a.tolist(), b.tolist())
        hit = links > 0
        none = [None] * int(hit.sum())
        return pa.table([
            pa.array([*of[hit].tolist(), *a[kept].tolist()], pa.int64()), pa.array([*links[hit].tolist(), *[0] * len(kept)], pa.int64()),
            pa.array([*none, *b[kept].tolist()], pa.int64()),
        ], schema=schema)

    found = left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(compare, "class bigint, links bigint, other bigint")
    return stored(found, "links")


def similar_vectors(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each row of ``vectors``
    (``vec_id``, ``label``, ``embedding``)."""
    rows = _described(vectors)
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("n")
    )
    classes = stored(classes, "classes")
    drawn = [r["vector"] for r in classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("vector").collect()]
    same = [v for v in drawn if len(v) // v[0] == len(drawn[0]) // drawn[0][0]]
    found = link_vectors(classes, Quantiser.fit(_units(same)) if same else None, cosine)
    counts = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    roots = roots.withColumnRenamed("id", "class")
    named = classes.select("class", "n").join(counts, "class", "left").join(roots, "class", "left").select(
        "class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root")
    )
    rows = stored(rows.select("vec_id", "class").join(named, "class", "left"), "named")
    least = rows.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    rows = rows.join(least, "root", "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
