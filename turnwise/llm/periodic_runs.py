"""Runs of a text's words: stretches that repeat a period, by Lyndon roots from Baier's grouping.

1.  *Lyndon arrays.* The first phase of Baier's suffix sorter splits positions into groups, from the
    highest to the lowest. A group's context is the string that its positions are known to begin with; when a
    position's group is reached, that context is the longest Lyndon word that begins there. This is done
    under the order of the words and under its reverse, so no suffix array is needed.
2.  *Runs.* Every run has a root that is the longest Lyndon word at its place under one of the two orders.
    Each such word is extended to both sides, by the longest common extension of its two ends, found in a
    table of names of all blocks of 1, 2, 4, ... words. Equal names mean equal words; nothing is hashed.

Only stretches that can hold a long run are sorted: in a run of period q and length m, all but the first q
words occur again q words back, so a stretch of ``m - q`` words has a former occurrence within q words.
Stretches without such words are passed over, which loses no run.

A text is one row and is handled in its task; nothing is shuffled. Null and empty texts have no words, no
runs and an empty collapsed text; repeated rows are reported each; only the named column is read, and a
column that has the result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: A run is reported from this length and this many periods on.
MIN_WORDS = 24
MIN_PERIODS = 3
#: Texts whose words are numbered together hold about so many bytes, or are one text.
BATCH_BYTES = 1 << 22


def lyndon_lengths(codes: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place; a prefix is less than the whole."""
    n = len(codes)
    group = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(group, kind="stable")
    members = [part.tolist() for part in np.split(order, np.cumsum(np.bincount(group))[:-1])]
    group = group.tolist()
    context = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    lengths = [0] * n
    g = len(members) - 1
    while g >= 0:
        size = context[g]
        parents: list[int] = []
        times: list[int] = []
        last = -1
        for i in members[g]:
            if group[i] != g:
                continue
            # A place leaves the chain, so the one behind it sees the nearest place of a lower group.
            lengths[i] = size
            p, r = left[i], right[i]
            if r < n:
                left[r] = p
            if p < 0:
                continue
            right[p] = r
            if p == last:
                times[-1] += 1
            else:
                parents.append(p)
                times.append(1)
                last = p
        members[g] = []
        # What more copies of the context follow is higher. New groups stand right above their old one.
        for count in sorted(set(times), reverse=True):
            fresh: dict[int, int] = {}
            for p, t in zip(parents, times):
                if t != count:
                    continue
                h = group[p]
                new = fresh.get(h)
                if new is None:
                    new = fresh[h] = len(members)
                    members.append([])
                    context.append(context[h] + count * size)
                    below.append(h)
                    above.append(above[h])
                    if above[h] >= 0:
                        below[above[h]] = new
                    above[h] = new
                members[new].append(p)
                group[p] = new
        g = below[g]
    return np.array(lengths, np.int64)


class Extensions:
    """Longest common extensions of places of one sequence, exact, by names of blocks of 2**k."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.names: list[np.ndarray] = []
        names = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        width = 1
        # Where all blocks of a width differ, no longer ones agree.
        while len(names) and names.max() + 1 < len(names):
            alone = -1 - np.arange(self.n + 1)
            alone[: len(names)] = names
            self.names.append(alone)
            if len(names) <= width:
                break
            pairs = names[:-width] * (names.max() + 1) + names[width:]
            names = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
            width *= 2

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and ``b`` on agree."""
        begin, a, b = b, a.copy(), b.copy()
        for k in range(len(self.names) - 1, -1, -1):
            step = (self.names[k][a] == self.names[k][b]).astype(np.int64) << k
            a, b = a + step, b + step
        return b - begin

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and ``b`` (``a < b``) agree."""
        begin, a, b = a, a.copy(), b.copy()
        for k in range(len(self.names) - 1, -1, -1):
            low = a - (1 << k)
            same = (low >= 0) & (self.names[k][low] == self.names[k][np.maximum(b - (1 << k), 0)])
            step = same.astype(np.int64) << k
            a, b = a - step, b - step
        return begin - a


def runs_of(codes: np.ndarray, least: int = MIN_WORDS, periods: int = MIN_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least so many words and periods, by start, then period."""
    n = len(codes)
    if n == 0:
        return np.zeros((0, 3), np.int64)
    places = np.arange(n)
    roots = [np.stack([places, lyndon_lengths(of)], axis=1) for of in (codes, codes.max() - codes)]
    roots = np.unique(np.concatenate(roots), axis=0)
    roots = roots[roots.sum(axis=1) < n]
    start, period = roots[:, 0], roots[:, 1]
    extensions = Extensions(codes)
    back = extensions.before(start, start + period)
    length = back + period + extensions.after(start, start + period)
    runs = np.stack([start - back, period, length], axis=1)[length >= np.maximum(least, periods * period)]
    return np.unique(runs, axis=0)[:, [0, 2, 1]]


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def hopeful(codes: np.ndarray, starts: np.ndarray, least: int = MIN_WORDS, periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """Disjoint parts (text, begin, end) of the texts that begin at ``starts``; every run lies in one of them.
    No word occurs in two texts."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    again = codes[order][1:] == codes[order][:-1]
    gap = np.full(n, n, np.int64)
    gap[order[1:][again]] = (order[1:] - order[:-1])[again]
    parts = []
    # A run of period q leaves a stretch of max(least - q, (periods - 1) * q) words, so at least this many.
    shortest = min(max(least - q, (periods - 1) * q) for q in range(1, least + 1))
    for begin, end in zip(*_stretches(gap < n)):
        if end - begin < shortest:
            continue
        # The first word of a text has no former occurrence, so a stretch lies in one text.
        text = int(np.searchsorted(starts, begin, side="right")) - 1
        own, width = gap[begin:end], 1
        while (periods - 1) * (width // 2 + 1) <= end - begin:
            need = max(shortest, least - width, (periods - 1) * (width // 2 + 1))
            for low, high in zip(*_stretches(own <= width)):
                if high - low >= need:
                    parts.append((text, max(int(starts[text]), int(begin + low) - width), int(begin + high)))
            width *= 2
    merged: list[tuple[int, int, int]] = []
    for text, begin, end in sorted(parts):
        if merged and merged[-1][0] == text and begin < merged[-1][2]:
            merged[-1] = (text, merged[-1][1], max(merged[-1][2], end))
        else:
            merged.append((text, begin, end))
    return merged


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, different for each text, and where each text begins."""
    codes: list[int] = []
    used = 0
    for words in texts:
        known: dict[bytes, int] = {}
        codes += [known.setdefault(word, used + len(known)) for word in words]
        used += len(known)
    sizes = np.array([len(words) for words in texts], np.int64)
    return np.array(codes, np.int64), np.concatenate([[0], np.cumsum(sizes)])


def _described(texts: list[list[bytes]], least: int, periods: int) -> list[dict]:
    """Runs and collapsed text of each text."""
    codes, starts = _numbered(texts)
    runs: dict[int, list] = {}
    for text, begin, end in hopeful(codes, starts, least, periods):
        found = runs_of(codes[begin:end], least, periods)
        found[:, 0] += begin - starts[text]
        runs.setdefault(text, []).append(found)
    out = []
    for at, words in enumerate(texts):
        own = np.concatenate(runs[at]) if at in runs else np.zeros((0, 3), np.int64)
        if len(own):
            own = own[np.lexsort((own[:, 2], own[:, 0]))]
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, own[:, 0] + own[:, 2], 1)
            np.add.at(depth, own[:, 0] + own[:, 1], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
        out.append(
            {
                "runs": [dict(zip(("start", "length", "period"), run)) for run in own.tolist()],
                "collapsed": b" ".join(words),
            }
        )
    return out


RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"struct<runs:array<{RUN}>,collapsed:%s>"
_FOUND = pa.struct(
    [
        ("runs", pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))),
        ("collapsed", pa.binary()),
    ]
)


def find_runs(
    docs: DataFrame, text: str = "text", into: str = "periodic", least: int = MIN_WORDS, periods: int = MIN_PERIODS,
) -> DataFrame:
    """``docs`` with a struct: all runs of the text's words, and the text without what they repeat.

    A word is what stands between spaces and the control characters 9 to 13. Collapsed texts keep a word
    unless a run holds it behind its first period, and join words by one space.
    """

    kept = [name for name in docs.columns if name != into]
    at = kept.index(text)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            words: list[list[bytes]] = []
            held = 0
            for value in batch.column(at).cast(pa.binary()):
                data = value.as_py() or b""
                if words and held + len(data) > BATCH_BYTES:
                    out += _described(words, least, periods)
                    words, held = [], 0
                words.append(data.split())
                held += len(data)
            out += _described(words, least, periods)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _FOUND)], [*kept, into])

    schema = StructType([*docs.select(*kept).schema.fields]).add(into, DataType.fromDDL(FOUND % "binary"))
    found = docs.select(*kept).mapInArrow(described, schema)
    return found.withColumn(into, F.col(into).cast(FOUND % "string"))


def report(found: DataFrame, periodic: str = "periodic") -> DataFrame:
    """Number of runs, the one with the most periods, and digests, for each document of ``find_runs``."""
    runs = F.col(f"{periodic}.runs")
    best = F.expr(
        f"""array_sort({periodic}.runs, (a, b) -> CASE
            WHEN a.length * b.period <> b.length * a.period
              THEN CASE WHEN a.length * b.period > b.length * a.period THEN -1 ELSE 1 END
            WHEN a.start <> b.start THEN CASE WHEN a.start < b.start THEN -1 ELSE 1 END
            WHEN a.period <> b.period THEN CASE WHEN a.period < b.period THEN -1 ELSE 1 END
            ELSE 0 END)"""
    )
    best = F.get(best, F.lit(0))
    line = lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    rows = found.select("doc_id", runs.alias("_runs"), F.col(f"{periodic}.collapsed").alias("_kept"), best.alias("_best"))
    return rows.select(
        "doc_id", F.array_size("_runs").cast("bigint").alias("n_runs"),
        *(F.col(f"_best.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("_runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("_kept"), 256).alias("collapsed_sha256"),
    )
