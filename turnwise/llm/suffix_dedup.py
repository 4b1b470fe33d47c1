"""Removal of long repeated byte strings by a distributed difference-cover suffix array.

1.  *Cutting down.* Texts are cut at places that depend on the eight bytes before them alone, so equal
    strings are cut alike. A window of 400 bytes belongs to the first cut in it; only cuts whose 136
    bytes around them occur again can have repeated windows. Where all bytes of a cut's windows occur
    again as a whole, its windows are settled, and one of the copies stands for them in what follows.
    Windows without a cut near their start are compared as they are.
2.  *Suffix array.* What is left is a text of phrases between cuts. Its suffixes are ranked by the
    difference-cover algorithm: triples at places 1 and 2 modulo 3 are sorted and named, the names are
    ranked by recursion unless they are all different, and the remaining suffixes are merged with them
    by their first phrases and the rank of the next sampled suffix. Sorting is Spark's range exchange.
3.  *Adjacent prefixes.* Neighbours in the suffix array are compared byte by byte, in files of the shared
    folder that tasks map into memory. The suffix that begins at any other byte of a window is its
    bytes before the cut and the cut's suffix, so two windows are equal when these bytes agree and no
    neighbour between the two suffixes falls short of the window's end.

The folder must be mounted at the same path on all machines. Equal texts are one text from the start.
Null and empty texts have no bytes; texts shorter than a window have nothing removed; repeated rows are
each other's copies. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import partitions, stored
from turnwise.llm.kneser_ney import _local
from turnwise.session import scratch_path

WINDOW = 400
GRAM = 8
#: One place in 2**CUT_BITS is a cut.
CUT_BITS = 5
#: A window's first cut is at most so far from its start, and so many bytes of it follow.
REACH = 272
AHEAD = WINDOW - REACH
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: The symbol after the end of a piece.
END = -(1 << 63)
SETTLED, OPEN = 0, 1
#: Texts that a task handles at once.
BATCH_DOCS = 500
#: Bytes of texts that are cut and hashed at once, or one longer text.
TEXT_BYTES = 1 << 18
#: Rows that a task judges at once, and the rest of the last key.
GROUP_ROWS = 50_000

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 17)
        of = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, np.uint64(b))
            steps[0] = 1
            of.append(np.multiply.accumulate(steps))
        _POWERS[base] = tuple(of)
    return _POWERS[base]


class Hasher:
    """Hashes of any substrings of one text, or of some in a row; equal strings hash alike at any place."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        power, self.inverse = _powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def mixed(*values: np.ndarray) -> np.ndarray:
    out = np.uint64(0x2545F4914F6CDD1D)
    for value in values:
        out = (out ^ np.asarray(value).astype(np.uint64)) * np.uint64(BASES[0])
        out = out ^ (out >> np.uint64(32))
    return out.view(np.int64)


def cuts_of(data: np.ndarray) -> np.ndarray:
    if len(data) < GRAM:
        return np.zeros(0, np.int64)
    grams = np.lib.stride_tricks.sliding_window_view(data, GRAM)
    grams = np.ascontiguousarray(grams).view("<u8")[:, 0]
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(BASES[1])
    return np.flatnonzero(grams >> np.uint64(64 - CUT_BITS) == 0) + GRAM


def _cuts_within(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts in ``data`` of the texts that lie there in a row, each one's text, and none across two texts."""
    cuts = cuts_of(data)
    of = np.searchsorted(offsets, cuts - GRAM, "right") - 1
    inside = cuts <= offsets[of + 1]
    return cuts[inside], of[inside]


def _expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start to before its end, and which range each is of."""
    lengths = np.maximum(ends - starts, 0)
    return np.repeat(starts, lengths) + _placed(lengths), np.repeat(np.arange(len(starts)), lengths)


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Of each cut with windows of the texts that lie in ``data`` in a row: hash around it, hash of all its
    windows, its text, the cut, its first and last window. Windows that have no cut near their start come
    one by one, with a cut of -1."""
    places, of = _cuts_within(data, offsets)
    last = np.diff(offsets) - WINDOW
    cuts = places - offsets[of]
    new = np.ones(len(of), bool)
    new[1:] = of[1:] != of[:-1]
    begin = np.zeros(len(cuts), np.int64)
    begin[1:] = cuts[:-1] - GRAM + 1
    begin[new] = 0
    low, high = np.maximum(begin, cuts - REACH), np.minimum(cuts - GRAM, last[of])
    bare, bare_of = _expanded(begin, np.minimum(cuts - REACH, last[of] + 1))
    bare_of = of[bare_of]
    after = np.zeros(len(last), np.int64)  # behind the last cut
    after[of] = np.maximum(0, cuts - GRAM + 1)
    rest, rest_of = _expanded(after, last + 1)
    bare, bare_of = np.append(bare, rest), np.append(bare_of, rest_of)
    real = low <= high
    of, cuts, low, high = of[real], cuts[real], low[real], high[real]
    one, two = Hasher(data), Hasher(data, BASES[1])
    at = offsets[of]
    around = mixed(one.of(at + cuts - GRAM, at + cuts + AHEAD))
    start, end = at + low, at + high + WINDOW
    whole = mixed(two.of(start, end), one.of(start, end), cuts - low, cuts - high)
    at = offsets[bare_of] + bare
    single = mixed(one.of(at, at + WINDOW), np.ones(len(bare)))
    check = mixed(two.of(at, at + WINDOW))
    pad = np.full(len(bare), -1)
    return [np.concatenate(x) for x in ((around, single), (whole, check), (of, bare_of), (cuts, pad), (low, bare), (high, bare))]


def _joined_runs(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of each text, runs that touch joined."""
    order = np.lexsort((low, keys))
    keys, low, high = keys[order], low[order], high[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (low[1:] > high[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(keys))[: len(starts)] - 1
    return keys[starts], low[starts], high[ends]


ANCHORS = "around bigint, whole bigint, class bigint, cut int, low int, high int, kind int, times int"
_ANCHORS = pa.schema([
    (c.split(" ")[0], pa.int64() if c.endswith("bigint") else pa.int32()) for c in ANCHORS.split(", ")
])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS):
            yield batch.slice(at, BATCH_DOCS)


def _by_bytes(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with TEXT_BYTES of ``text`` or one row, the bytes of their texts, and where each begins
    and the last one ends."""
    text = batch.column("text")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    offsets = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(text):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + TEXT_BYTES, "right")) - 1)
        yield batch.slice(first, end - first), data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def _batch(columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c).cast(f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _settle(around: np.ndarray, whole: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order, and in it: first of its whole, number of the whole, number of the around."""
    order = np.lexsort((whole, around))
    a, w = around[order], whole[order]
    new_a = np.concatenate([[True], a[1:] != a[:-1]])
    new_w = new_a | np.concatenate([[True], w[1:] != w[:-1]])
    group_w, group_a = np.cumsum(new_w) - 1, np.cumsum(new_a) - 1
    n_w = np.bincount(group_w, times[order]).astype(np.int64)[group_w]
    wholes = np.bincount(group_a, new_w).astype(np.int64)[group_a]
    return order, new_w, n_w, wholes


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield [c.to_numpy() for c in batch.columns]


def _settled(columns: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Settled rows of these open ones, the first row of each whole in order of ``around``, and which of
    those stay open."""
    order, first, n, wholes = _settle(columns[0], columns[1], columns[7])
    columns = [c[order] for c in columns]
    copies = (n > 1) & (columns[7] < 2)  # a row that stands for copies is settled already
    keys, low, high = _joined_runs(*(columns[i][copies] for i in (2, 4, 5)))
    none = np.zeros(len(keys), np.int64)
    columns[7] = np.minimum(n, 2)
    return [none, none, keys, none, low, high, none + SETTLED, none + 1], [c[first] for c in columns], (wholes > 1)[first]


def find_anchors(texts: DataFrame) -> DataFrame:
    """Settled and open cuts (ANCHORS) of ``class``, ``text``. Copies within a task are settled there, and
    one row for them goes on."""
    def emit(batches):
        for batch in _slices(batches):
            found = []
            for some, data, offsets in _by_bytes(batch):
                columns = anchors_of(data, offsets)
                columns[2] = some.column("class").to_numpy()[columns[2]]
                found.append(columns)
            around, whole, keys, cut, low, high = (np.concatenate(x) for x in zip(*found))
            if not len(around):
                continue
            order, first, n, _ = _settle(around, whole, np.ones(len(around)))
            columns = [x[order] for x in (around, whole, keys, cut, low, high)]
            copies = n > 1
            # A settled row needs no partner, so it goes to any task.
            keys, low, high = _joined_runs(*(c[copies] for c in (columns[2], columns[4], columns[5])))
            none = np.zeros(len(keys), np.int64)
            yield _batch([mixed(keys, low), none, keys, none, low, high, none + SETTLED, none + 1], _ANCHORS)
            yield _batch([c[first] for c in columns] + [np.full(first.sum(), OPEN), np.minimum(n[first], 2)], _ANCHORS)

    def settle(batches):
        # Rows come sorted by ``around``. Of a group that goes on, one row of each whole is held.
        held = [np.zeros(0, np.int64)] * 8
        for columns in _columns(batches):
            done = columns[6] == SETTLED
            if done.any():
                yield _batch([c[done] for c in columns], _ANCHORS)
            columns = [np.concatenate([h, c[~done]]) for h, c in zip(held, columns)]
            if not len(columns[0]):
                continue
            settled, held, left = _settled(columns)
            yield _batch(settled, _ANCHORS)
            goes_on = held[0] == held[0][-1]
            yield _batch([c[left & ~goes_on] for c in held], _ANCHORS)
            held = [c[goes_on] for c in held]
        if len(held[0]):
            _, held, left = _settled(held)
            yield _batch([c[left] for c in held], _ANCHORS)

    sent = texts.select("class", "text").mapInArrow(emit, ANCHORS)
    return sent.repartition(partitions(texts.sparkSession), "around").sortWithinPartitions("around").mapInArrow(settle, ANCHORS)


# --- The suffix array ------------------------------------------------------------------------------


def _less_than(rows: DataFrame, keys: list[str], flags: list[str], ties: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """``rows`` with, for each 0/1 flag, how many flagged rows have smaller keys (``less_...``); and whether
    all keys differ.

    A range exchange sorts; each range counts within itself, and the totals of the ranges before are
    added, of which there is one row for each range. A key that many rows share is dealt to several
    ranges by ``ties``; the rows of a range that go on with the last key of the one before count from
    where that key began.
    """
    spark = rows.sparkSession
    names = rows.columns
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + "".join(f", less_{f} bigint" for f in flags) + ", part int, head int, new int"

    def number(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        total = np.zeros(len(flags), np.int64)  # flagged rows so far
        at_key, last, head = total.copy(), None, True  # the same before the current key
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.ones(batch.num_rows, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
            new[0] = last is None or any(k[0] != x for k, x in zip(key, last))
            group = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            # The first key of the range ends where the second one begins.
            second = starts[last is None :][:1] if head else [0]
            heads = (np.arange(batch.num_rows) < (second[0] if len(second) else batch.num_rows)).astype(np.int32)
            head = bool(heads[-1])
            columns = []
            for i, flag in enumerate(flags):
                of = batch.column(flag).to_numpy().astype(np.int64)
                begun = (total[i] + np.cumsum(of) - of)[starts]
                columns.append(np.where(group >= 0, begun[np.maximum(group, 0)] if len(begun) else 0, at_key[i]))
                if len(begun):
                    at_key[i] = begun[-1]
                total[i] += of.sum()
            last = [k[-1] for k in key]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, *(pa.array(c) for c in columns), pa.array(np.full(batch.num_rows, part), pa.int32()),
                    pa.array(heads), pa.array(new.astype(np.int32)),
                ],
                names=[*batch.schema.names, *(f"less_{f}" for f in flags), "part", "head", "new"],
            )

    ordered = rows.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys)
    counted = stored(ordered.mapInArrow(number, schema), "ranked")
    key = F.struct(*keys)
    ranges = counted.groupBy("part").agg(
        F.count("*").alias("n"), F.sum("new").alias("keys"), F.min(key).alias("low"), F.max(key).alias("high"),
        *(F.sum(f).alias(f"sum_{f}") for f in flags), *(F.max(f"less_{f}").alias(f"last_{f}") for f in flags),
    ).collect()  # a row a range
    if not ranges:
        return counted.drop("part", "head", "new"), True
    base, high, differ = [], None, True
    running = began = [0] * len(flags)
    for row in sorted(ranges, key=lambda r: r["part"]):
        goes_on = row["low"] == high
        differ = differ and row["n"] == row["keys"] and not goes_on
        base.append((row["part"], *running, *(began if goes_on else running)))
        if row["low"] != row["high"] or not goes_on:
            began = [r + row[f"last_{f}"] for r, f in zip(running, flags)]
        running = [r + row[f"sum_{f}"] for r, f in zip(running, flags)]
        high = row["high"]
    columns = "part int" + "".join(f", {b}_{f} bigint" for b in ("base", "head") for f in flags)
    # As many rows as there are ranges.
    joined = counted.join(F.broadcast(spark.createDataFrame(base, columns)), "part")
    less = (
        F.when(F.col("head") == 1, F.col(f"head_{f}")).otherwise(F.col(f"less_{f}") + F.col(f"base_{f}")).alias(f"less_{f}")
        for f in flags
    )
    return joined.select(*names, *less), differ


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and its rows' lengths."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(), lengths


def _placed(lengths: np.ndarray) -> np.ndarray:
    starts = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) - np.repeat(starts, lengths)


def _after(values: np.ndarray, places: np.ndarray, lengths: np.ndarray, by: int, end: int) -> np.ndarray:
    """Each place's value ``by`` places on, ``end`` beyond its row."""
    left = np.repeat(lengths, lengths) - places
    out = np.full(len(values), end, np.int64)
    at = np.flatnonzero(left > by)
    out[at] = values[at + by]
    return out


def _to_arrays(rows: DataFrame, also: Callable | None = None, schema: str = "piece bigint, values array<bigint>") -> DataFrame:
    """One array for each piece of ``piece``, ``place`` and ``value``, values in order of place; those of one
    place are added. ``also`` turns the batches of arrays into others, in the same pass."""
    def arrays(batches):
        held = [np.zeros(0, np.int64)] * 3
        for columns in _columns(batches):
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            whole = columns[0] != columns[0][-1]
            held = [c[~whole] for c in columns]
            if whole.any():
                yield _gathered(*(c[whole] for c in columns))
        if len(held[0]):
            yield _gathered(*held)

    rows = rows.select("piece", F.col("place").cast("bigint").alias("place"), F.col("value").cast("bigint").alias("value"))
    ordered = rows.repartition("piece").sortWithinPartitions("piece", "place")
    return ordered.mapInArrow(lambda batches: also(arrays(batches)) if also else arrays(batches), schema)


def _gathered(pieces: np.ndarray, places: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    new = np.concatenate([[True], (pieces[1:] != pieces[:-1]) | (places[1:] != places[:-1])])
    sums, pieces = np.add.reduceat(values, np.flatnonzero(new)), pieces[new]
    starts = np.flatnonzero(np.concatenate([[True], pieces[1:] != pieces[:-1]]))
    offsets = pa.array(np.append(starts, len(pieces)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(pieces[starts]), pa.ListArray.from_arrays(offsets, pa.array(sums))], names=["piece", "values"])


def rank_suffixes(texts: DataFrame, also: Callable | None = None, schema: str = "piece bigint, values array<bigint>") -> DataFrame:
    """The suffix array of all pieces, by the difference-cover algorithm.

    ``texts``: ``piece`` and ``values``, its symbols as integers. Returns ``piece`` and ``values``, for
    each place how many suffixes of all pieces are smaller. A piece's end is smaller than any symbol.
    ``also`` and its ``schema``: as in ``_to_arrays``.
    """
    def triples(batches):
        for batch in batches:
            values, lengths = _flat(batch.column("values"))
            places = _placed(lengths)
            pieces = np.repeat(batch.column("piece").to_numpy(), lengths)
            second, third = (_after(values, places, lengths, k, END) for k in (1, 2))
            of = places % 3 > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[of]) for x in (pieces, places, values, second, third)], names=["piece", "place", "x", "y", "z"]
            )

    triple = "x bigint, y bigint, z bigint"
    sampled = stored(texts.mapInArrow(triples, f"piece bigint, place bigint, {triple}"), "triples")
    # A triple's name is how many sampled triples are smaller, so names differ where the triples do.
    named, differ = _less_than(sampled.withColumn("one", F.lit(1)), ["x", "y", "z"], ["one"], ("piece", "place"))
    named = named.select("piece", "place", F.col("less_one").alias("value"))
    if differ:
        ranks = _to_arrays(named)
    else:
        # The names at places 1, 4, ... and 2, 5, ... are two pieces of the text one level up.
        halves = named.select(
            (F.col("piece") * 2 + F.col("place") % 3 - 1).alias("piece"), F.floor(F.col("place") / 3).alias("place"), "value"
        )

        def back(batches):
            for batch in batches:
                values, lengths = _flat(batch.column("values"))
                half = np.repeat(batch.column("piece").to_numpy(), lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(half >> 1), pa.array(_placed(lengths) * 3 + 1 + (half & 1)), pa.array(values)], names=["piece", "place", "value"]
                )

        ranks = _to_arrays(rank_suffixes(stored(_to_arrays(halves), "level"), back, "piece bigint, place bigint, value bigint"))
    both = texts.join(ranks.withColumnRenamed("values", "ranks"), "piece", "left")
    return _merge(stored(both, "merge"), also, schema)


def _merge(both: DataFrame, also: Callable | None, schema: str) -> DataFrame:
    """Ranks of all suffixes from the symbols and the sampled suffixes' ranks (0-based, in place order).

    A remaining suffix (place 0 modulo 3) is compared with those at places 1 by one symbol and the rank
    of the next suffix, with those at places 2 by two symbols and the rank of the one after. Both
    comparisons are one order, the first before the second.
    """
    def keys(batches):
        for batch in batches:
            values, lengths = _flat(batch.column("values"))
            places = _placed(lengths)
            pieces = np.repeat(batch.column("piece").to_numpy(), lengths)
            rank = np.zeros(len(values), np.int64)  # 0 is beyond the end
            of = places % 3 > 0
            rank[of] = batch.column("ranks").flatten().to_numpy() + 1
            rest = (places % 3 == 0).astype(np.int32)
            for step in (1, 2):
                second = _after(values, places, lengths, 1, END) if step == 2 else np.zeros(len(values), np.int64)
                key = _after(rank, places, lengths, step, 0)
                part = (places % 3 == 0) | (places % 3 == step)
                columns = (np.full(len(values), step, np.int32), pieces, places, values, second, key, rank, rest, 1 - rest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[part]) for x in columns],
                    names=["step", "piece", "place", "x", "y", "next", "own", "rest", "sampled"],
                )

    columns = "step int, piece bigint, place bigint, x bigint, y bigint, next bigint, own bigint, rest int, sampled int"
    rows = both.mapInArrow(keys, columns)
    counted, _ = _less_than(rows, ["step", "x", "y", "next"], ["rest", "sampled"], ("piece", "place"))
    # What the second step counts has all rows of the first one before it.
    n = both.agg(*(F.coalesce(F.sum(F.floor((F.size("values") + k) / 3)), F.lit(0)) for k in (2, 1))).first()
    first = F.col("step") == 1
    less_rest = F.col("less_rest") - F.when(first, 0).otherwise(n[0])
    less_sampled = F.col("less_sampled") - F.when(first, 0).otherwise(n[1])
    # The remaining suffixes are in both steps, and are counted among themselves in the first one.
    among = F.when(first, less_rest).otherwise(0)
    value = F.when(F.col("rest") == 1, among + less_sampled).otherwise(F.col("own") - 1 + less_rest)
    return _to_arrays(counted.select("piece", "place", value.alias("value")), also, schema)


# --- From suffixes to windows ----------------------------------------------------------------------

PIECES = (
    "class bigint, file string, offset bigint, length bigint, start bigint, cuts array<bigint>, symbols array<bigint>, "
    "phrases array<binary>, "
    "around array<bigint>, low array<bigint>, high array<bigint>, times array<bigint>"
)


def write_pieces(open_texts: DataFrame, folder: str) -> DataFrame:
    """Write the bytes that open cuts need to files below ``folder`` and describe them (PIECES).

    Arrays have an entry for each cut of the piece; ``low`` is above ``high`` where no window is open.
    """
    schema = _piece_schema()

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        name, offset = f"{folder}/{uuid.uuid4().hex}", 0
        with open(name, "wb") as file:
            for batch in _slices(batches):
                for some, data, offsets in _by_bytes(batch):
                    data, columns = _described(data, offsets, some.column("anchors"))
                    columns["class"] = pa.array(some.column("class").to_numpy()[columns["class"]])
                    columns["file"] = pa.array([name] * len(columns["class"]), pa.string())
                    columns["offset"] = pa.array(columns["offset"] + offset)
                    file.write(data.tobytes())
                    offset += len(data)
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name]) for f in schema], schema=schema)

    pieces = stored(open_texts.mapInArrow(write, PIECES), "pieces")
    return stored(pieces.withColumn("piece", F.monotonically_increasing_id()), "numbered")


def rank_phrases(pieces: DataFrame) -> DataFrame:
    """``piece`` and ``values``: each phrase's rank in the order of bytes, so that suffixes which share
    more bytes are nearer in the suffix array. A phrase that the piece's end cuts off comes first."""
    phrase = F.explode(F.arrays_zip("cuts", "symbols", "phrases"))
    rows = pieces.select("piece", "length", phrase.alias("p")).select(
        "piece", F.col("p.cuts").alias("place"), F.col("p.symbols").alias("symbol"), F.col("p.phrases").alias("phrase"),
        (F.col("p.cuts") + F.octet_length("p.phrases") < F.col("length")).cast("int").alias("ended"),
    )
    distinct = rows.groupBy("symbol").agg(F.first("phrase").alias("phrase"), F.first("ended").alias("ended"), F.lit(1).alias("one"))
    names = _less_than(distinct, ["phrase", "ended"], ["one"])[0].select("symbol", F.col("less_one").alias("value"))
    return stored(_to_arrays(rows.select("piece", "place", "symbol").join(names, "symbol")), "text")


def _piece_schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in PIECES.split(", "))])


def _described(data: np.ndarray, offsets: np.ndarray, anchors: pa.ListArray) -> tuple[np.ndarray, dict]:
    """The pieces of texts that lie in ``data`` in a row, one after another, and their columns: ``class`` is the
    number of the text, ``offset`` the place in the bytes returned. A piece is a merged range of bytes that the
    windows of the texts' open cuts cover."""
    cut, low, high, times = (anchors.flatten().field(c).to_numpy().astype(np.int64) for c in ("cut", "low", "high", "times"))
    text = np.repeat(np.arange(len(anchors)), np.diff(anchors.offsets.to_numpy()))
    order = np.lexsort((times, high, low, cut, text))
    text, cut, low, high, times = (x[order] for x in (text, cut, low, high, times))
    base = offsets[text]
    ends = np.maximum.accumulate(base + high + WINDOW)
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (base[1:] + low[1:] > ends[:-1])
    first = np.flatnonzero(new)
    piece = np.cumsum(new) - 1  # of each anchor
    starts, ends = (base + low)[first], ends[np.append(first[1:], len(text))[: len(first)] - 1]
    data = np.concatenate([data[:0], *(data[a:b] for a, b in zip(starts.tolist(), ends.tolist()))])
    at = np.concatenate([[0], np.cumsum(ends - starts)])  # of each piece in the data now
    cuts, of = _cuts_within(data, at)
    local = cuts - at[of]
    ends = at[of + 1].copy()
    same = of[1:] == of[:-1]
    ends[:-1][same] = cuts[1:][same]
    hashes = Hasher(data)
    # A symbol names the phrase's bytes and whether a cut ends it, which is not known of the last one.
    symbols = mixed(hashes.of(cuts, ends), ends - cuts, ends == at[of + 1])
    around = mixed(hashes.of(cuts - GRAM, np.minimum(cuts + AHEAD, at[of + 1])))
    start = low[first]
    lows, highs, n = np.zeros(len(cuts), np.int64), np.full(len(cuts), -1, np.int64), np.zeros(len(cuts), np.int64)
    place = np.searchsorted(cuts, at[piece] + cut - start[piece])
    lows[place], highs[place], n[place] = low - start[piece], high - start[piece], times
    phrases, _ = _expanded(cuts, ends)
    phrases = pa.Array.from_buffers(
        pa.binary(), len(cuts), [None, pa.py_buffer(np.append(0, np.cumsum(ends - cuts)).astype(np.int32)), pa.py_buffer(data[phrases].tobytes())]
    )
    lists = pa.array(np.searchsorted(of, np.arange(len(first) + 1)), pa.int32())
    columns = {"cuts": local, "symbols": symbols, "phrases": phrases, "around": around, "low": lows, "high": highs, "times": n}
    columns = {c: pa.ListArray.from_arrays(lists, pa.array(v)) for c, v in columns.items()}
    return data, {"class": text[first], "offset": at[:-1], "length": np.diff(at), "start": start, **columns}


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b), WINDOW)
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def repeated_windows(rows: dict[str, np.ndarray], maps: list[np.ndarray]) -> np.ndarray:
    """Of the suffixes of one task, sorted by ``around`` and rank: (row, first byte) of each window that
    occurs again. ``rows``: arrays around, file (number in ``maps``), at, end, cut, low, high, times."""
    n = len(rows["at"])
    reach = np.zeros(n, np.int64)  # bytes in common with the suffix before
    same = np.flatnonzero(rows["around"][1:] == rows["around"][:-1]) + 1
    starts = rows["at"] + rows["cut"]
    for i in same.tolist():
        a = maps[rows["file"][i]][starts[i] : rows["end"][i]]
        b = maps[rows["file"][i - 1]][starts[i - 1] : rows["end"][i - 1]]
        reach[i] = common_prefix(a, b)
    hashes = np.zeros(n, np.uint64)
    open_rows = np.flatnonzero(rows["high"] >= rows["low"])
    # The bytes between each row's first window and its cut.
    left = [maps[f][a - k : a] for f, a, k in zip(rows["file"].tolist(), starts.tolist(), (rows["cut"] - rows["low"]).tolist())]
    left_ends = np.cumsum([len(x) for x in left])
    left = np.concatenate(left) if left else np.zeros(0, np.uint8)
    found = []
    for ahead in range(1, REACH + 1):  # bytes of the window before the cut
        active = open_rows[rows["cut"][open_rows] - rows["low"][open_rows] >= ahead]
        if not len(active):
            break
        hashes[active] = hashes[active] * np.uint64(BASES[0]) + _BYTES[left[left_ends[active] - ahead]]
        live = active[(rows["cut"][active] - rows["high"][active]) <= ahead]
        if ahead < GRAM or not len(live):
            continue
        # Suffixes are in one group while neighbours share the rest of the window.
        group = np.cumsum((reach < WINDOW - ahead) | (np.arange(n) == 0))
        order = np.lexsort((hashes[live], group[live]))
        g, h = group[live][order], hashes[live][order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])])
        number = np.cumsum(new) - 1
        times = np.bincount(number, rows["times"][live][order])[number]
        hit = live[order[times > 1]]
        found.append(np.stack([hit, rows["cut"][hit] - ahead]))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


SPANS = "class bigint, low bigint, high bigint"


def _runs(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (keys, low, high)], names=["class", "low", "high"])


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of GROUP_ROWS rows or more of a stream sorted by ``key``, each key's rows in one of them."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        at = int(np.searchsorted(values, values[-1]))
        # Where one key fills the batch, the rows held may be of the same one.
        if n + at >= GROUP_ROWS and at:
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held, n, batch = [], 0, batch.slice(at)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def compare_neighbours(pieces: DataFrame, ranks: DataFrame) -> DataFrame:
    """SPANS of windows (first to last) that occur again, those that touch in one where a task has them at once."""
    described = pieces.join(ranks.withColumnRenamed("values", "ranks"), "piece")
    schema = "around bigint, rank bigint, class bigint, file string, at bigint, end bigint, start bigint, cut bigint, low bigint, high bigint, times bigint"

    def suffixes(batches):
        for batch in batches:
            values = {c: _flat(batch.column(c))[0] for c in ("cuts", "around", "low", "high", "times", "ranks")}
            lengths = _flat(batch.column("cuts"))[1]
            open_rows = values["high"] >= values["low"]
            of = np.repeat(np.arange(batch.num_rows), lengths)[open_rows]
            file = pa.DictionaryArray.from_arrays(pa.array(of, pa.int32()), batch.column("file")).cast(pa.string())
            offset, length = batch.column("offset").to_numpy(), batch.column("length").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(values["around"][open_rows]), pa.array(values["ranks"][open_rows]), pa.array(batch.column("class").to_numpy()[of]),
                    file, pa.array(offset[of]), pa.array((offset + length)[of]), pa.array(batch.column("start").to_numpy()[of]),
                    *(pa.array(values[c][open_rows]) for c in ("cuts", "low", "high", "times")),
                ],
                names=[c.split(" ")[0] for c in schema.split(", ")],
            )

    def judge(batches):
        for table in _whole_groups(batches, "around"):
            coded = table.column("file").combine_chunks().dictionary_encode()
            rows = {c: table.column(c).to_numpy() for c in table.column_names if c != "file"}
            rows["file"] = coded.indices.to_numpy()
            order = np.lexsort((rows["rank"], rows["around"]))
            # Files are mapped for these groups alone.
            maps = [np.asarray(np.memmap(f, np.uint8, "r")) for f in coded.dictionary.to_pylist()]
            rows = {c: v[order] for c, v in rows.items()}
            hit, first = repeated_windows(rows, maps)
            del maps
            first = rows["start"][hit] + first
            yield _runs(*_joined_runs(rows["class"][hit], first, first))

    rows = described.mapInArrow(suffixes, schema)
    return rows.repartition(partitions(rows.sparkSession), "around").sortWithinPartitions("around").mapInArrow(judge, SPANS)


REMOVED = "n_removed bigint, n_spans bigint, kept_sha256 string"


def removed_runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows from ``low`` to ``high`` (first bytes) cover."""
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(high[order] + WINDOW)
    new = np.concatenate([[True], low[1:] > end[:-1]])
    starts = np.flatnonzero(new)
    return low[starts], end[np.append(starts[1:], len(low)) - 1]


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` digest columns: ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    A byte is removed where a string of WINDOW bytes covers it that starts anywhere else too.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.xxhash64(text).alias("class"), F.sha2(text, 256).alias("sha")
    )
    rows = stored(rows, "documents")
    copies = stored(rows.groupBy("class").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "copies")
    # One text of each class goes on; the ids of the others are few beside the texts. An id may have other texts too.
    others = stored(
        rows.join(copies.filter("n > 1 and first IS NOT NULL"), "class").filter("NOT doc_id <=> first").select(F.col("doc_id").alias("_id"), F.col("class").alias("_class")).distinct(),
        "others",
    )
    texts = docs.select("doc_id", F.xxhash64(text).alias("class"), text.alias("text")).filter(F.octet_length("text") >= WINDOW)
    same = (F.col("doc_id") == F.col("_id")) & (F.col("class") == F.col("_class"))
    texts = texts.join(others, same, "left_anti").select("class", "text")
    anchors = stored(find_anchors(texts), "anchors")
    listed = anchors.groupBy("class").agg(F.collect_list(F.struct("cut", "low", "high", "kind", "times")).alias("anchors"))
    held = stored(texts.join(listed, "class").dropDuplicates(["class"]), "held")
    # Bare windows are settled or single, never open: their hash is the whole window's.
    is_open = lambda a: (a["kind"] == OPEN) & (a["cut"] >= 0)
    opened = held.select("class", "text", F.filter("anchors", is_open).alias("anchors")).filter(F.size("anchors") > 0)
    pieces = write_pieces(opened, _local(scratch_path(spark, "suffixes")))
    ranks = rank_suffixes(rank_phrases(pieces))
    found = compare_neighbours(pieces, ranks)
    settled = anchors.filter(F.col("kind") == SETTLED).select("class", F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"))
    spans = found.unionByName(settled).groupBy("class").agg(
        F.collect_list(F.struct("low", "high")).alias("spans")
    )

    def cut(batches):
        for batch in _slices(batches):
            out, spans = [], batch.column("spans")
            low, high = (spans.flatten().field(c).to_numpy() for c in ("low", "high"))
            at = spans.offsets.to_numpy() - spans.offsets[0].as_py()
            for key, value, a, b in zip(batch.column("class").to_pylist(), batch.column("text"), at.tolist(), at[1:].tolist()):
                data = value.as_buffer()
                starts, ends = removed_runs(low[a:b], high[a:b])
                kept = hashlib.sha256()
                for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]):
                    kept.update(data[a:b])
                out.append((key, int((ends - starts).sum()), len(starts), kept.hexdigest()))
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["class", "n_removed", "n_spans", "kept_sha256"],
            )

    removed = held.select("class", "text").join(spans, "class").mapInArrow(cut, f"class bigint, {REMOVED}")
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= WINDOW)
    rows = rows.join(copies.select("class", "n"), "class").join(removed, "class", "left")
    return rows.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
