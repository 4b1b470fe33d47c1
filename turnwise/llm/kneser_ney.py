"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark and stored as sorted arrays.

Every table of the model is cut into buckets of files in the shared folder: the sorted 64-bit hashes of
the words (a word's number is its place in them) with their counts, the sorted pairs of word numbers
with their counts, how many words follow a word once, twice and more often, and how many different
words come before it. Tasks send sorted arrays of distinct keys and their counts to the buckets, so
what is shuffled is a few bytes for each distinct key of a task, not a row for each word. Scoring
maps the files into memory and looks up the sorted distinct keys of a batch; the model is never copied
into a worker's or the driver's memory, and grows with the corpus on disk alone.

The pairs that begin with a very common word are spread over all buckets by their second word, so such
a word is no bucket of its own. The folder must be mounted at the same path on all machines, as
memory maps need files; a file is written under another name and renamed, so a task that is run again
replaces it.

Texts are lower-cased (A-Z); tokens are the words between ASCII white space and one end mark. Null and
empty texts are the end mark alone. Without training tokens both scores are those of an unknown word
in an empty model (N = V = 0).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import partitions, stored
from turnwise.session import scratch_path

#: Tokens after which a task sends what it has counted.
FLUSH_TOKENS = 4_000_000
BATCH_DOCS = 1000
#: A word with more than this share of a bucket's even load is spread over the buckets.
HOT_SHARE = 0.5
END = xxhash.xxh3_64_intdigest(b" ")  # no word has a space
COUNTS = "bucket int, keys binary, counts binary"
NO_WORD = np.uint64(0xFFFFFFFF)


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens in a row, and the number of each text's tokens."""
    spaced = pc.ascii_lower(pc.fill_null(texts, ""))
    for separator in "\t\n\x0b\x0c\r":
        spaced = pc.replace_substring(spaced, pattern=separator, replacement=" ")
    pieces = pc.split_pattern(spaced, pattern=" ")
    words = pieces.flatten().dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    distinct = np.fromiter(
        (digest(w) if w else 0 for w in pc.cast(words.dictionary, pa.binary()).to_pylist()),
        np.uint64, len(words.dictionary),
    )
    empty = pc.equal(words.dictionary, "").to_numpy(zero_copy_only=False)
    order = words.indices.to_numpy()
    ends = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
    real = ~empty[order]
    lengths = np.diff(np.concatenate([[0], np.cumsum(real)])[ends])
    hashes = np.insert(distinct[order[real]], np.cumsum(lengths), np.uint64(END))
    return hashes, lengths + 1


def _range_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return keys ^ (keys >> np.uint64(33))


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys byte by byte, which compresses better."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
    return keys[first], (np.add.reduceat(counts, first) if len(keys) else counts)


def _to_buckets(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """Rows of COUNTS from sorted keys."""
    order = np.argsort(bucket, kind="stable")
    keys, counts, bucket = keys[order], counts[order], bucket[order]
    present, starts = np.unique(bucket, return_index=True)
    ends = [*starts[1:], len(keys)]
    return pa.RecordBatch.from_arrays([
        pa.array(present, pa.int32()),
        pa.array([_planes(keys[a:b]) for a, b in zip(starts, ends)], pa.binary()),
        pa.array([counts[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)], pa.binary()),
    ], names=["bucket", "keys", "counts"])


def _gathered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The summed counts of a bucket's rows."""
    keys = [_unplaned(k.as_py()) for k in rows.column("keys")]
    counts = [np.frombuffer(c.as_py(), "<u4").astype(np.int64) for c in rows.column("counts")]
    return _summed(np.concatenate(keys), np.concatenate(counts))


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory maps need a mounted folder, not {path}")
    return path


def _save(folder: str, name: str, bucket: int, values: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{uuid.uuid4().hex}"
    values.tofile(own)
    os.replace(own, f"{folder}/{name}-{bucket}")


MAPS: dict[str, np.ndarray] = {}


def _map(folder: str, name: str, bucket: int, kind: str) -> np.ndarray:
    path = f"{folder}/{name}-{bucket}"
    if path not in MAPS:
        there = os.path.exists(path) and os.path.getsize(path)
        MAPS[path] = np.memmap(path, kind, "r") if there else np.zeros(0, kind)
    return MAPS[path]


@dataclass
class PairModel:
    """Where the files are, and the few numbers that go with them."""

    folder: str
    buckets: int
    bases: np.ndarray  # the number of words before each bucket's
    tokens: int
    words: int
    hot: np.ndarray  # sorted numbers of the words whose pairs are spread
    starts: int = 0  # training texts
    follow_hot: np.ndarray | None = None  # words that follow a hot word once, twice, more often
    pair_discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    pairs: int = 0
    words_after: tuple = (0, 0, 0)  # words with one, two, more different words before them

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, NO_WORD for unknown ones. ``hashes`` sorted and distinct."""
        out = np.full(len(hashes), NO_WORD, np.uint64)
        for bucket, at in _by_bucket(_range_of(hashes, self.buckets)):
            known = _map(self.folder, "words", bucket, "<u8")
            place = np.searchsorted(known, hashes[at])
            found = place < len(known)
            found[found] = known[place[found]] == hashes[at][found]
            out[at[found]] = (self.bases[bucket] + place[found]).astype(np.uint64)
        return out

    def of_words(self, numbers: np.ndarray, name: str, kind: str, width: int = 1) -> np.ndarray:
        """A value kept beside the words, 0 for unknown ones. ``numbers`` sorted and distinct."""
        out = np.zeros((len(numbers), width), np.int64)
        known = np.flatnonzero(numbers < self.words)
        buckets = np.searchsorted(self.bases, numbers[known].astype(np.int64), side="right") - 1
        for bucket, at in _by_bucket(buckets):
            rows = _map(self.folder, name, bucket, kind).reshape(-1, width)
            if len(rows):
                out[known[at]] = rows[numbers[known[at]].astype(np.int64) - self.bases[bucket]]
        return out

    def pair_bucket(self, pairs: np.ndarray) -> np.ndarray:
        first = (pairs >> np.uint64(32)).astype(np.int64)
        own = np.searchsorted(self.bases, np.minimum(first, max(0, self.words - 1)), side="right") - 1
        spread = np.isin(first, self.hot) | (first >= self.words)
        return np.where(spread, (_mixed(pairs) % np.uint64(self.buckets)).astype(np.int64), own)

    def count_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """``pairs`` sorted and distinct."""
        out = np.zeros(len(pairs), np.int64)
        for bucket, at in _by_bucket(self.pair_bucket(pairs)):
            known = _map(self.folder, "pairs", bucket, "<u8")
            place = np.searchsorted(known, pairs[at])
            found = place < len(known)
            found[found] = known[place[found]] == pairs[at][found]
            out[at[found]] = _map(self.folder, "pair_counts", bucket, "<u4")[place[found]]
        return out

    def followers(self, numbers: np.ndarray) -> np.ndarray:
        out = self.of_words(numbers, "follow", "<u4", 3)
        spread = np.flatnonzero(np.isin(numbers, self.hot.astype(np.uint64)) | (numbers == self.words))
        place = np.searchsorted(np.append(self.hot, self.words), numbers[spread].astype(np.int64))
        out[spread] = self.follow_hot[place]
        return out


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(buckets, kind="stable")
    present, starts = np.unique(buckets[order], return_index=True)
    for bucket, start, end in zip(present.tolist(), starts, [*starts[1:], len(order)]):
        yield bucket, order[start:end]


def _pairs_of(model: PairModel, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each token's pair with the one before it; a text's first token follows the start, which has the
    number after the last word's."""
    before = np.concatenate([[np.uint64(model.words)], numbers[:-1]]).astype(np.uint64)
    before[np.cumsum(lengths)[:-1]] = np.uint64(model.words)
    return (before << np.uint64(32)) | numbers


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of keys with counts 1 to 4. A discount is from 0 to the count, and
    one half where there are too few keys to tell."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    values = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(v, 0.0), k) for k, v in enumerate(values, 1))


def _reduce(counted: DataFrame, buckets: int, function, schema: str) -> DataFrame:
    return counted.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(function, schema)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_DOCS):
            yield batch.slice(at, BATCH_DOCS)


def train(docs: DataFrame, spark: SparkSession) -> PairModel:
    """Count a model of the ``text`` of all rows."""
    folder, buckets = _local(scratch_path(spark, "kneser-ney")), partitions(spark)
    texts = docs.select("text")

    def count_words(batches):
        held, n = [], 0
        for batch in _slices(batches):
            hashes, _ = token_hashes(batch.column("text"))
            keys, counts = np.unique(hashes, return_counts=True)
            held.append((keys, counts))
            n += len(keys)
            if n >= FLUSH_TOKENS // 4:
                keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
                yield _to_buckets(keys, counts, _range_of(keys, buckets))
                held, n = [], 0
        if held:
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
            yield _to_buckets(keys, counts, _range_of(keys, buckets))

    def keep_words(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        keys, counts = _gathered(rows)
        _save(folder, "words", bucket, keys.astype("<u8"))
        _save(folder, "word_counts", bucket, counts.astype("<u8"))
        starts = int(counts[keys == np.uint64(END)].sum())
        return pa.table({"bucket": [bucket], "words": [len(keys)], "tokens": [int(counts.sum())], "starts": [starts]},
                        schema=pa.schema([("bucket", pa.int32()), *((c, pa.int64()) for c in ("words", "tokens", "starts"))]))

    kept = _reduce(texts.mapInArrow(count_words, COUNTS), buckets, keep_words, "bucket int, words bigint, tokens bigint, starts bigint")
    sizes = {r["bucket"]: r for r in kept.collect()}  # a row for each bucket
    n_words = np.array([sizes[b]["words"] if b in sizes else 0 for b in range(buckets)], np.int64)
    tokens = sum(r["tokens"] for r in sizes.values())
    model = PairModel(folder, buckets, np.cumsum(n_words) - n_words, tokens, int(n_words.sum()), np.zeros(0, np.int64))
    model.starts = sum(r["starts"] for r in sizes.values())
    if model.words >= int(NO_WORD):
        raise ValueError("more words than 32 bits number")
    least = HOT_SHARE * tokens / buckets

    def find_hot(batches):
        for batch in batches:
            for bucket in batch.column("id").to_pylist():
                counts = _map(folder, "word_counts", bucket, "<u8")
                yield pa.RecordBatch.from_pydict({"number": pa.array(model.bases[bucket] + np.flatnonzero(counts > least), pa.int64())})

    hot = spark.range(0, buckets, 1, min(buckets, 16)).mapInArrow(find_hot, "number bigint").collect()
    model.hot = np.array(sorted(r["number"] for r in hot), np.int64)  # at most buckets / HOT_SHARE

    def count_pairs(batches):
        held, n = [], 0
        for batch in _slices(batches):
            hashes, lengths = token_hashes(batch.column("text"))
            distinct, back = np.unique(hashes, return_inverse=True)
            held.append(_pairs_of(model, model.numbers(distinct)[back], lengths))
            n += len(hashes)
            if n >= FLUSH_TOKENS:
                keys, counts = np.unique(np.concatenate(held), return_counts=True)
                yield _to_buckets(keys, counts, model.pair_bucket(keys))
                held, n = [], 0
        if held:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield _to_buckets(keys, counts, model.pair_bucket(keys))

    def keep_pairs(rows: pa.Table) -> pa.Table:
        """Rows of COUNTS: under -1 the numbers of pairs with counts 1 to 4, under -2 those of words that
        follow a hot word, under a bucket the words that pairs end in and in how many."""
        bucket = rows.column("bucket")[0].as_py()
        keys, counts = _gathered(rows)
        _save(folder, "pairs", bucket, keys.astype("<u8"))
        _save(folder, "pair_counts", bucket, counts.astype("<u4"))
        first, times = (keys >> np.uint64(32)).astype(np.int64), np.minimum(counts, 3) - 1
        spread = np.isin(first, model.hot) | (first >= model.words)
        own = n_words[bucket]
        cell = (first[~spread] - model.bases[bucket]) * 3 + times[~spread]
        _save(folder, "follow", bucket, np.bincount(cell, minlength=own * 3).astype("<u4"))
        far, n_far = np.unique(first[spread] * 3 + times[spread], return_counts=True)
        ends, n_ends = np.unique(keys & NO_WORD, return_counts=True)
        to = np.searchsorted(model.bases, ends.astype(np.int64), side="right") - 1
        tables = [_to_buckets(ends, n_ends, to)]
        of = np.bincount(np.minimum(counts, 5), minlength=6)
        for name, some, n in ((-1, np.arange(1, 6), of[1:]), (-2, far, n_far)):
            tables.append(_to_buckets(some.astype(np.uint64), n, np.full(len(some), name)))
        return pa.Table.from_batches(tables)

    paired = stored(_reduce(texts.mapInArrow(count_pairs, COUNTS), buckets, keep_pairs, COUNTS), "pairs")

    def summed(name: int) -> tuple[np.ndarray, np.ndarray]:
        rows = paired.filter(F.col("bucket") == name).toArrow()
        return _gathered(rows) if rows.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def cells(found: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[found[0].astype(np.int64)] = found[1]
        return out

    of = cells(summed(-1), 6)
    model.pair_discounts, model.pairs = discounts(of[1:5]), int(of[1:].sum())
    cell, n = summed(-2)  # at most three for each hot word
    spread = np.append(model.hot, model.words)
    place = np.searchsorted(spread, cell.astype(np.int64) // 3)
    model.follow_hot = cells((place * 3 + cell.astype(np.int64) % 3, n), 3 * len(spread)).reshape(-1, 3)

    def keep_before(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        keys, counts = _gathered(rows)
        before = np.zeros(n_words[bucket], "<u4")
        before[keys.astype(np.int64) - model.bases[bucket]] = counts
        _save(folder, "before", bucket, before)
        of = np.bincount(np.minimum(counts, 5), minlength=6)[1:]
        return pa.table({"n": pa.array([of.tolist()], pa.list_(pa.int64()))})

    kept = _reduce(paired.filter("bucket >= 0"), buckets, keep_before, "n array<bigint>").collect()
    of = np.sum([r["n"] for r in kept], axis=0) if kept else np.zeros(5, np.int64)
    model.word_discounts = discounts(of[:4])
    model.words_after = (int(of[0]), int(of[1]), int(of[2:].sum()))
    return model


def _discounted(counts: np.ndarray, by: tuple) -> np.ndarray:
    cut = np.array([0.0, *by])[np.minimum(counts, 3)]
    return np.maximum(counts - cut, 0)


def score_tokens(model: PairModel, texts: pa.Array) -> dict[str, np.ndarray]:
    """For each text its tokens, known tokens, base score and model score (log10)."""
    hashes, lengths = token_hashes(texts)
    distinct, back = np.unique(hashes, return_inverse=True)
    numbers = model.numbers(distinct)
    pairs = _pairs_of(model, numbers[back], lengths)
    # Values of each distinct word, in the order of its number.
    words, to_word = np.unique(numbers, return_inverse=True)
    counts = model.of_words(words, "word_counts", "<u8")[:, 0]
    before = model.of_words(words, "before", "<u4")[:, 0]
    types = max(model.pairs, 1)
    rest = float(np.dot(model.words_after, model.word_discounts)) / types if model.pairs else 1.0
    single = _discounted(before, model.word_discounts) / types + rest / (model.words + 1)
    of_token = to_word[back]
    keys, to_key = np.unique(pairs, return_inverse=True)
    firsts, to_first = np.unique(keys >> np.uint64(32), return_inverse=True)
    follow = model.followers(firsts) if model.words else np.zeros((len(firsts), 3))
    total = model.of_words(firsts, "word_counts", "<u8")[:, 0]
    total[firsts == np.uint64(model.words)] = model.starts
    seen = total > 0
    spared = np.where(seen, follow @ np.array(model.pair_discounts) / np.maximum(total, 1), 1.0)
    held = _discounted(model.count_pairs(keys), model.pair_discounts) if model.words else np.zeros(len(keys))
    held = held / np.maximum(total[to_first], 1)
    chance = held[to_key] + spared[to_first][to_key] * single[of_token]
    base = np.log10((counts + 1) / (model.tokens + model.words + 1))
    starts = np.cumsum(lengths) - lengths
    by_text = lambda x: np.add.reduceat(x, starts) if len(lengths) else x[:0]
    return {
        "n_tokens": lengths.astype(np.int64), "n_known": by_text((counts > 0)[of_token].astype(np.int64)),
        "base_score": by_text(base[of_token]), "score": by_text(np.log10(chance)),
    }


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score_documents(docs: DataFrame, held_out: Column, model: PairModel) -> DataFrame:
    """SCORED and ``train_tokens`` for every row of ``docs``."""
    def score(batches):
        for batch in _slices(batches):
            found = score_tokens(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), *(pa.array(v) for v in found.values())],
                names=["doc_id", "held_out", *found],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(score, SCORED).withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
