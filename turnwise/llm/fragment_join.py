"""Jaccard self-join of word shingles by vertical partitioning.

All n-grams of the corpus have one global order, rare ones first. It is cut into fragments at pivots
that hold equal shares of all n-grams; the overlap of two documents is counted in each fragment apart
and summed per pair. Pairs are candidates where the rarest n-grams of both, as many as a pair must
share one of, have one in common at places that still allow the needed overlap.

Documents with the same set are one class from the start. The order goes by counts in a fixed number
of hashed cells, so it is known to every task, exact to recompute, and of a fixed size; any order gives
the same pairs. Candidates are enumerated in posting lists (lists beyond ``LIST_ROWS`` in blocks by two
parts each), travel packed in arrays, and are verified in tiles of documents that share a rarest
partner, where each document's fragment is sent once for many pairs. Of the links only spanning ones
leave a tile, and components are found by rounds of joins.

Words are what lies between ASCII white space, A-Z lower-cased. A document of fewer words than a
shingle, but not none, has the whole sequence as its one n-gram; one without words or text has an empty
set and links with nothing. Repeated rows and rows with the same id are in the class of their set.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import partitions, stored
from turnwise.llm.components import components, spanning
from turnwise.llm.kneser_ney import token_hashes

CELL_BITS = 20
FRAGMENTS = 4
#: A prefix is longer by one in so many, and candidates share that many more n-grams.
EXTRA = 8
#: Documents in a tile's side, and rows of a posting list that are compared in one task.
TILE_DOCS = 256
LIST_ROWS = 4096
BATCH_DOCS = 1000
#: Candidate pairs that a task gathers before it sends them on.
FLUSH_PAIRS = 500_000
#: Cells that travel in one row.
CHUNK = 1 << 14


def shingles(texts: pa.Array, size: int, distinct: bool = True) -> Iterator[np.ndarray]:
    """The n-grams' hashes of each text; sorted and distinct, or as they come."""
    hashes, lengths = token_hashes(texts)  # the last token of each text is an end mark
    ends = np.cumsum(lengths)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for start, end in zip(ends - lengths, ends - 1):
        words = hashes[start:end]
        n = min(size, len(words))
        if not n:
            yield words
            continue
        grams = np.full(len(words) - n + 1, np.uint64(n))
        for k in range(n):
            grams = (grams ^ words[k : len(words) - n + 1 + k]) * odd
            grams ^= grams >> np.uint64(29)
        yield np.unique(grams) if distinct else grams


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS):
            yield batch.slice(at, BATCH_DOCS)


def count_cells(docs: DataFrame, size: int) -> np.ndarray:
    """How many n-grams fall into each of the fixed number of cells."""
    def count(batches):
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in _slices(batches):
            grams = list(shingles(batch.column("text"), size, False))
            if grams:
                total += np.bincount(_cells(np.concatenate(grams)), minlength=len(total))
        chunks = total.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_pydict({
            "chunk": pa.array(np.arange(len(chunks)), pa.int32()), "n": pa.array([c.tobytes() for c in chunks], pa.binary()),
        })

    def total(rows: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("n"))
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    schema = "chunk int, n binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("chunk").applyInArrow(total, schema).collect()
    cells = np.zeros((1 << CELL_BITS) // CHUNK * CHUNK, np.int64).reshape(-1, CHUNK)
    for row in rows:
        cells[row["chunk"]] = np.frombuffer(row["n"], np.int64)
    return cells.reshape(-1)


def pivots(cells: np.ndarray, fragments: int) -> np.ndarray:
    """Cell counts at which the order is cut, so that fragments hold equal shares of all n-grams."""
    counts = np.sort(cells[cells > 0])
    if not len(counts):
        return np.zeros(fragments - 1, np.int64)
    mass = np.cumsum(counts)
    shares = mass[-1] * np.arange(1, fragments) / fragments
    return counts[np.minimum(np.searchsorted(mass, shares), len(counts) - 1)]


def _least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of these sizes whose similarity is high enough."""
    return -(-percent * (n + m) // (100 + percent))


def describe_sets(docs: DataFrame, size: int, percent: int, cells: np.ndarray, carried: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class`` (of the set; null where empty), ``prefix``: the rarest
    n-grams in order, as many as any linked pair must share ``needed`` of; and the bigints ``carried``."""
    schema = ", ".join(["doc_id bigint, n_shingles bigint, class bigint, prefix array<bigint>", *(f"{c} bigint" for c in carried)])

    def describe(batches):
        for batch in _slices(batches):
            n, classes, prefixes = [], [], []
            for grams in shingles(batch.column("text"), size):
                n.append(len(grams))
                classes.append(xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) if len(grams) else None)
                size_of = np.int64(len(grams))
                if len(grams) and 100 * len(grams) >= percent * (len(grams) + 1):
                    order = np.lexsort((grams, cells[_cells(grams)]))
                    order = order[: spare(size_of, percent) + needed(size_of, percent)]
                    prefixes.append(grams[order].view(np.int64))
                else:  # too small to link even with a set of one n-gram more
                    prefixes.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), *(batch.column(c) for c in carried)],
                names=["doc_id", "n_shingles", "class", "prefix", *carried],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carried).mapInArrow(describe, schema)


PAIRS = "a bigint, n bigint, others array<bigint>, sizes array<bigint>, common array<bigint>"
#: Pairs, and the postings of long lists, which have a token.
FOUND = f"{PAIRS}, token bigint"


def spare(n: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams of a set of n may be missing from a linked one."""
    return n - -(-percent * n // 100)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams the prefixes of two linked sets share at least: as many as they are longer than
    the number that may be missing."""
    return 1 + spare(n, percent) // EXTRA


def _list_pairs(token, block, side, doc, n, place, percent: int) -> Iterator[pa.RecordBatch]:
    """Candidates within posting lists, packed by their smaller class. ``side`` 0 and 1 are two parts of a
    long list that meet in this block, 2 is compared with itself."""
    order = np.lexsort((doc, n, block, token))
    token, block, side, doc, n, place = (x[order] for x in (token, block, side, doc, n, place))
    found, held = [], 0
    left = np.arange(len(token))
    step = 1
    while len(left):
        left = left[left + step < len(token)]
        right = left + step
        # Sizes ascend, so a list's later rows can only be larger: a row that fails here is done.
        near = (token[left] == token[right]) & (block[left] == block[right]) & (100 * n[left] >= percent * n[right])
        left, right = left[near], right[near]
        mixed = (side[left] != side[right]) | (side[left] == 2)
        a, b = left[mixed], right[mixed]
        possible = np.minimum(place[a], place[b]) + np.minimum(n[a] - place[a], n[b] - place[b])
        good = possible >= _least_overlap(n[a], n[b], percent)
        a, b = a[good], b[good]
        found.append(np.stack([doc[a], n[a], doc[b], n[b], np.ones(len(a), np.int64)]))
        held += len(a)
        if held >= FLUSH_PAIRS:
            yield from _packed(np.concatenate(found, axis=1))
            found, held = [], 0
        step += 1
    if held:
        yield from _packed(np.concatenate(found, axis=1))


def _packed(pairs: np.ndarray, percent: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of PAIRS, equal pairs summed. With ``percent``, only those that share enough."""
    a, n, b, m, common = pairs
    swap = a > b
    a, b, n, m = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, m, n), np.where(swap, n, m)
    order = np.lexsort((b, a))
    a, b, n, m, common = (x[order] for x in (a, b, n, m, common))
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    common = np.add.reduceat(common, np.flatnonzero(new)) if len(a) else common
    a, b, n, m = a[new], b[new], n[new], m[new]
    if percent is not None:
        enough = common >= np.minimum(needed(n, percent), needed(m, percent))
        a, b, n, m, common = a[enough], b[enough], n[enough], m[enough], common[enough]
    if not len(a):
        return
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    offsets = pa.array(np.append(starts, len(a)), pa.int32())
    yield pa.RecordBatch.from_arrays(
        [pa.array(a[starts]), pa.array(n[starts]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (b, m, common))],
        names=["a", "n", "others", "sizes", "common"],
    )


def _unpacked(table: pa.Table) -> np.ndarray:
    others = table.column("others").combine_chunks()
    lengths = np.diff(others.offsets.to_numpy()) if table.num_rows else np.zeros(0, np.int64)
    flat = lambda name: table.column(name).combine_chunks().flatten().to_numpy()
    first = lambda name: np.repeat(table.column(name).to_numpy(), lengths)
    return np.stack([first("a"), first("n"), flat("others"), flat("sizes"), flat("common")])


def _columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray] | None:
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    table = pa.Table.from_batches(held)
    return [table.column(c).to_numpy().astype(np.int64) for c in names]


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs as rows of PAIRS. ``classes``: ``class``, ``n_shingles``, ``prefix``."""
    spark = classes.sparkSession
    entries = classes.select(
        F.posexplode("prefix").alias("place", "token"), "class", F.col("n_shingles").cast("int").alias("n")
    )

    def short_lists(batches):
        columns = _columns(batches, ("token", "class", "n", "place"))
        if columns is None:
            return
        order = np.argsort(columns[0], kind="stable")
        token, doc, n, place = (c[order] for c in columns)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        size = np.repeat(sizes, sizes)
        kept = (size > 1) & (size <= LIST_ROWS)
        none = np.zeros(int(kept.sum()), np.int64)
        for batch in _list_pairs(token[kept], none, none + 2, doc[kept], n[kept], place[kept], percent):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.int64())], names=[*batch.schema.names, "token"])
        for start, rows in zip(starts[sizes > LIST_ROWS], sizes[sizes > LIST_ROWS]):
            for at in range(start, start + rows, LIST_ROWS):
                end = min(at + LIST_ROWS, start + rows)
                lists = [pa.array([x[at:end]], pa.list_(pa.int64())) for x in (doc, n, place)]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *lists, pa.array([token[at]])],
                    names=["a", "n", "others", "sizes", "common", "token"],
                )

    found = stored(entries.repartition(partitions(spark), "token").mapInArrow(short_lists, FOUND), "found")
    pairs = found.filter("token IS NULL").drop("token")
    long = found.filter("token IS NOT NULL")
    if not long.isEmpty():
        pairs = pairs.unionByName(_long_lists(long, percent))

    def once(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _packed(_unpacked(pa.Table.from_batches(held)), percent)

    return pairs.repartition(partitions(spark), "a").mapInArrow(once, PAIRS)


def _long_lists(long: DataFrame, percent: int) -> DataFrame:
    """Pairs of lists beyond LIST_ROWS. A list is cut into c parts by class; part i meets part j in a block
    of its own, and itself in one with side 2."""
    spark = long.sparkSession
    sizes = long.groupBy("token").agg(F.ceil(F.sum(F.size("others")) / (LIST_ROWS // 2)).cast("int").alias("c"))
    posting = F.explode(F.arrays_zip("others", "sizes", "common"))
    rows = long.select("token", posting.alias("p")).join(sizes, "token").select(
        "token", "c", F.col("p.others").alias("class"), F.col("p.sizes").alias("n"), F.col("p.common").alias("place")
    )
    rows = rows.withColumn("part", F.pmod(F.xxhash64("class"), F.col("c")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1))).select(
        "token", (F.least("part", "other") * F.col("c") + F.greatest("part", "other")).cast("int").alias("block"),
        F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
        "class", "n", "place",
    )

    def compare(batches):
        columns = _columns(batches, ("token", "block", "side", "class", "n", "place"))
        if columns is not None:
            yield from _list_pairs(*columns, percent)

    return rows.repartition(partitions(spark), "token", "block").mapInArrow(compare, PAIRS)


def fragment_sets(docs: DataFrame, wanted: DataFrame, size: int, cells: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """``bucket``, ``fragment``, ``class`` and ``grams`` of the ``wanted`` classes (``class``, ``doc_id`` of a
    member, the ``buckets`` it is sent to)."""
    schema = "bucket bigint, fragment int, class bigint, grams binary"

    def cut(batches):
        for batch in _slices(batches):
            rows = []
            wanted_classes, buckets = (batch.column(c).to_pylist() for c in ("class", "buckets"))
            for key, to, grams in zip(wanted_classes, buckets, shingles(batch.column("text"), size)):
                if not len(grams) or xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63) != key:
                    continue  # another row with the same id
                of = np.searchsorted(cuts, cells[_cells(grams)], side="left")
                for fragment in range(len(cuts) + 1):
                    part = grams[of == fragment].tobytes()
                    rows += [(bucket, fragment, key, part) for bucket in to]
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "fragment", "class", "grams"]
            )

    wanted = wanted.select("class", F.col("doc_id").alias("_id"), "buckets")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("class", "buckets", "text")
    return rows.mapInArrow(cut, schema)


def _overlaps(grams: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common n-grams of each pair in one fragment of one tile."""
    if len(a) < 32:
        return np.array([
            len(np.intersect1d(grams[x], grams[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())
        ], np.int64)
    rows, row_of = np.unique(a, return_inverse=True)
    columns, column_of = np.unique(b, return_inverse=True)
    left = [grams[x] for x in rows.tolist()]
    right = [grams[y] for y in columns.tolist()]
    # N-grams of both sides; each side is a 0/1 matrix over them.
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(rows), len(columns)), np.float32)
    for at in range(0, len(known), 4096):
        some = known[at : at + 4096]
        total += _indicator(left, some) @ _indicator(right, some).T
    return total[row_of, column_of].astype(np.int64)


def _indicator(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(known)), np.float32)
    for row, grams in enumerate(sets):
        place = np.searchsorted(known, grams)
        hit = place < len(known)
        hit[hit] = known[place[hit]] == grams[hit]
        out[row, place[hit]] = 1
    return out


def link_classes(docs: DataFrame, described: DataFrame, size: int, percent: int, cells: np.ndarray, fragments: int) -> DataFrame:
    """Spanning links ``a``, ``b`` between classes."""
    spark = docs.sparkSession
    members = described.filter(F.size("prefix") > 0).groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix")
    )
    classes = stored(members, "classes")
    pairs = stored(candidates(classes, percent), "candidates")
    # A class's tile side: its smallest partner, in parts of about TILE_DOCS classes.
    sides = _sides(pairs)
    tiled = stored(_tiles(pairs, sides, spark), "tiles")
    inside = tiled.select("bucket", F.explode("inside").alias("class")).groupBy("class").agg(
        F.collect_set("bucket").alias("buckets")
    )
    wanted = inside.join(classes.select("class", "doc_id"), "class")
    by_fragment = fragment_sets(docs, wanted, size, cells, pivots(cells, fragments))
    requests = tiled.select(F.col("bucket").alias("bucket"), "tile", "a", "b", "n", "m", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment"))
    partial_schema = "bucket bigint, tile bigint, a binary, b binary, n binary, m binary, common binary"

    def count(wanted_rows: pa.Table, set_rows: pa.Table) -> pa.Table:
        grams = {c: np.frombuffer(g, np.uint64) for c, g in zip(set_rows.column("class").to_pylist(), set_rows.column("grams").to_pylist())}
        out = []
        for row in wanted_rows.to_pylist():
            a, b = (np.frombuffer(row[c], np.int64) for c in "ab")
            row["common"] = _overlaps(grams, a, b).tobytes()
            del row["fragment"]
            out.append(row)
        kinds = [("bucket", pa.int64()), ("tile", pa.int64()), *((c, pa.binary()) for c in ("a", "b", "n", "m", "common"))]
        return pa.Table.from_pylist(out, schema=pa.schema(kinds))

    keys = ["bucket", "fragment"]
    partial = requests.groupBy(*keys).cogroup(by_fragment.groupBy(*keys)).applyInArrow(count, partial_schema)

    def decide(rows: pa.Table) -> pa.Table:
        total: dict[int, np.ndarray] = {}
        seen = {}
        for row in rows.to_pylist():
            common = np.frombuffer(row["common"], np.int64)
            total[row["tile"]] = total.get(row["tile"], 0) + common
            seen[row["tile"]] = row
        linked = []
        for tile, common in total.items():
            a, b, n, m = (np.frombuffer(seen[tile][c], np.int64) for c in "abnm")
            good = 100 * common >= percent * (n + m - common)
            linked += zip(a[good].tolist(), b[good].tolist())
        kept = spanning(*zip(*linked)) if linked else []
        return pa.table({c: pa.array([linked[k][i] for k in kept], pa.int64()) for i, c in enumerate("ab")})

    return partial.groupBy("bucket").applyInArrow(decide, "a bigint, b bigint")


def _sides(pairs: DataFrame) -> DataFrame:
    """``class``, its ``group`` (named by the smallest partner) and the group's ``parts``."""
    def least(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            a, _, b, _, _ = _unpacked(table)
            ids = np.concatenate([a, b, a])
            to = np.concatenate([a, a, b])
            low = np.minimum(ids, to)
            order = np.lexsort((low, ids))
            ids, low = ids[order], low[order]
            first = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(low[first])], names=["class", "low"])

    low = stored(pairs.mapInArrow(least, "class bigint, low bigint").groupBy("class").agg(F.min("low").alias("group")), "groups")
    sizes = low.groupBy("group").agg(F.ceil(F.count("*") / TILE_DOCS).alias("parts"))
    return low.join(sizes, "group")


def _tiles(pairs: DataFrame, sides: DataFrame, spark) -> DataFrame:
    """Packed pairs by tile: ``bucket``, ``tile``, arrays ``a``, ``b``, ``n``, ``m`` and ``inside``.

    A tile is one part of a group against one part of its members' partners.
    """
    buckets = 4 * partitions(spark)
    rows = pairs.join(sides.withColumnRenamed("class", "a"), "a").withColumn(
        "own", F.xxhash64("group", F.pmod(F.xxhash64("a"), F.col("parts")))
    )
    schema = "bucket bigint, tile bigint, a binary, b binary, n binary, m binary"

    def cut(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                b = np.array(row["others"], np.int64)
                m = np.array(row["sizes"], np.int64)
                part = (b.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(row["parts"])
                for other in np.unique(part).tolist():
                    at = part == other
                    k = int(at.sum())
                    tile = xxhash.xxh3_64_intdigest(np.array([row["own"], other], np.int64).tobytes()) - (1 << 63)
                    # Tiles of one part of a group share their documents, so they go together.
                    out.append((row["own"] % buckets, tile, np.full(k, row["a"], np.int64).tobytes(), b[at].tobytes(), np.full(k, row["n"], np.int64).tobytes(), m[at].tobytes()))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:2]), *(pa.array(c, pa.binary()) for c in columns[2:])],
                names=["bucket", "tile", "a", "b", "n", "m"],
            )

    cut_rows = rows.select("a", "n", "others", "sizes", "own", "parts").mapInArrow(cut, schema)

    def join_up(rows: pa.Table) -> pa.Table:
        by_tile: dict[int, list] = {}
        for row in rows.to_pylist():
            by_tile.setdefault(row["tile"], []).append(row)
        out = []
        for tile, parts in by_tile.items():
            columns = {c: b"".join(p[c] for p in parts) for c in "abnm"}
            inside = np.unique(np.frombuffer(columns["a"] + columns["b"], np.int64))
            out.append({"bucket": parts[0]["bucket"], "tile": tile, **columns, "inside": inside.tolist()})
        kinds = [("bucket", pa.int64()), ("tile", pa.int64()), *((c, pa.binary()) for c in "abnm"), ("inside", pa.list_(pa.int64()))]
        return pa.Table.from_pylist(out, schema=pa.schema(kinds))

    return cut_rows.groupBy("bucket").applyInArrow(
        join_up, "bucket bigint, tile bigint, a binary, b binary, n binary, m binary, inside array<bigint>"
    )


def similar_documents(
    docs: DataFrame, size: int = 5, percent: int = 80, fragments: int = FRAGMENTS, carried: Sequence[str] = ()
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class``, ``component_id`` and ``root`` of each row of ``docs``, and its
    bigint columns ``carried``.

    Two documents link when ``100 * intersection >= percent * union``; the component is the smallest
    document id reachable by links. ``root`` is the component's own key, null for an empty set.
    """
    cells = count_cells(docs, size)
    described = stored(describe_sets(docs, size, percent, cells, carried), "described")
    links = stored(link_classes(docs, described, size, percent, cells, fragments), "links")
    roots = components(links)
    rows = described.select("doc_id", "n_shingles", "class", *carried)
    rows = rows.join(roots, rows["class"] == roots["id"], "left").withColumn("_root", F.coalesce("root", "class"))
    rows = stored(rows.select("doc_id", "n_shingles", "class", "_root", *carried), "rooted")
    least = rows.filter("_root IS NOT NULL").groupBy("_root").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(least, "_root", "left")
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    return rows.select("doc_id", "n_shingles", "class", component, F.col("_root").alias("root"), *carried)
