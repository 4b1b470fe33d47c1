"""Token ids in binary files of patched frame-of-reference blocks.

A *file row* holds a run of whole documents in order: their ids and token counts, and their token
ids in blocks of 128. Of each block the minimum is subtracted, the rest is packed at the width that
holds a given share of its values, and the values that do not fit are kept whole in an exception
list. Two index arrays say where each block's packed words and exceptions start, so that any block
can be read alone. Spark writes and commits the rows as Parquet, on any file system, and a task that
is run again replaces its own file; the block bytes are the format of this module.

Documents are in ascending order of their id (null first; equal ids by a hash of the text, then the
text). A null or empty text is the end id alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnwise.llm.common import partitions

BLOCK = 128
#: Ids after which a file row is closed; it then ends with the current document.
ROW_IDS = 1 << 17
#: Distinct stems whose ids a worker keeps from batch to batch.
CACHE_STEMS = 700_000
#: Documents that are encoded together.
BATCH_DOCS = 2000
#: Marks at a word's end, and the Latin letters before them, of which an encoder takes those that its tokenizer
#: splits from every mark.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]

FILE_SCHEMA = (
    "part int, seq int, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, "
    "minima binary, widths binary, block_starts binary, packed binary, "
    "exception_starts binary, exception_places binary, exception_values binary"
)
DIGEST_SCHEMA = (
    "part int, seq int, doc_id bigint, place bigint, n_tokens bigint, ids_crc32 bigint"
)
IDS_SCHEMA = "part int, seq int, doc_id bigint, place bigint, n_tokens bigint, ids array<int>"


def pack_blocks(ids: np.ndarray, share: float = 0.9) -> dict[str, bytes]:
    """The parts of the format for one run of ids; ``share`` of each block's values fit its width."""
    n_blocks = -(-len(ids) // BLOCK)
    values = np.zeros(n_blocks * BLOCK, np.uint64)
    values[: len(ids)] = ids
    if n_blocks:
        values[len(ids) :] = values[(n_blocks - 1) * BLOCK : len(ids)].min()
    values = values.reshape(n_blocks, BLOCK)
    minima = values.min(axis=1) if n_blocks else np.zeros(0, np.uint64)
    values -= minima[:, None]
    rank = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    limit = np.partition(values.astype(np.uint32), rank, axis=1)[:, rank] if n_blocks else minima
    widths = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.int64)
    rows, places = np.nonzero(values >> widths[:, None].astype(np.uint64))
    starts = np.zeros(n_blocks + 1, np.int64)
    np.cumsum(widths * (BLOCK // 64), out=starts[1:])
    packed = np.zeros(starts[-1], np.uint64)
    for width in np.unique(widths[widths > 0]).tolist():
        of_width = np.flatnonzero(widths == width)
        packed[_word_places(starts, of_width, width)] = _pack(values[of_width], width)
    exceptions = np.zeros(n_blocks + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=n_blocks), out=exceptions[1:])
    return {
        "minima": minima.astype("<u4").tobytes(),
        "widths": widths.astype(np.uint8).tobytes(),
        "block_starts": starts.astype("<u4").tobytes(),
        "packed": packed.astype("<u8").tobytes(),
        "exception_starts": exceptions.astype("<u4").tobytes(),
        "exception_places": places.astype(np.uint8).tobytes(),
        "exception_values": values[rows, places].astype("<u4").tobytes(),
    }


def unpack_blocks(n_ids: int, parts: dict[str, bytes]) -> np.ndarray:
    minima = np.frombuffer(parts["minima"], "<u4").astype(np.uint64)
    widths = np.frombuffer(parts["widths"], np.uint8).astype(np.int64)
    starts = np.frombuffer(parts["block_starts"], "<u4").astype(np.int64)
    packed = np.frombuffer(parts["packed"], "<u8")
    exceptions = np.frombuffer(parts["exception_starts"], "<u4").astype(np.int64)
    values = np.zeros((len(minima), BLOCK), np.uint64)
    for width in np.unique(widths[widths > 0]).tolist():
        of_width = np.flatnonzero(widths == width)
        values[of_width] = _unpack(packed[_word_places(starts, of_width, width)], width)
    rows = np.repeat(np.arange(len(minima)), np.diff(exceptions))
    places = np.frombuffer(parts["exception_places"], np.uint8)
    values[rows, places] = np.frombuffer(parts["exception_values"], "<u4")
    values += minima[:, None]
    return values.reshape(-1)[:n_ids].astype("<u4")


def _word_places(starts: np.ndarray, blocks: np.ndarray, width: int) -> np.ndarray:
    return starts[blocks][:, None] + np.arange(width * BLOCK // 64)


def _slots(n: int, width: int):
    """Where each of ``n`` values of a block lies: its number, first word, shift, and bits in the next word."""
    for j in range(n):
        word, shift = divmod(j * width, 64)
        yield j, word, np.uint64(shift), max(0, shift + width - 64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    low = (values & np.uint64((1 << width) - 1)).T.copy()
    # Neighbours become one value of twice the width as long as a word holds it.
    while width <= 32 and len(low) > 1:
        low = low[::2] | low[1::2] << np.uint64(width)
        width *= 2
    words = np.zeros((width * len(low) // 64, len(values)), np.uint64)
    for j, word, shift, over in _slots(len(low), width):
        words[word] |= low[j] << shift
        if over:
            words[word + 1] |= low[j] >> np.uint64(width - over)
    return words.T


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = words.T.copy()
    n, joined = BLOCK, width
    while joined <= 32 and n > 1:
        n, joined = n // 2, joined * 2
    values = np.empty((n, words.shape[1]), np.uint64)
    mask = np.uint64((1 << joined) - 1)
    for j, word, shift, over in _slots(n, joined):
        value = words[word] >> shift
        if over:
            value |= words[word + 1] << np.uint64(joined - over)
        values[j] = value & mask
    while joined > width:
        joined //= 2
        halves = np.empty((2 * len(values), values.shape[1]), np.uint64)
        halves[::2], halves[1::2] = values & np.uint64((1 << joined) - 1), values >> np.uint64(joined)
        values = halves
    return values.T


class WordEncoder:
    """A tokenizer of white-space separated words, with the ids of the last stems kept.

    No token crosses a space or a line feed, which the tokenizer drops, so a text's ids are those of
    its pieces between them. A piece that is Latin letters and a run of marks is looked up in
    its two parts, which the tokenizer splits as well, and ASCII letters in lower case. Arrow finds the
    distinct words of a batch, so Python sees each of them once.
    """

    def __init__(self, path: str):
        # Spark runs a worker for each core; threads within them only add memory and switching.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        #: Whether a token ends a word; nowhere if the vocabulary does not say.
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.letters = f"^[{''.join(self._split_letters())}]+$"
        #: The stems kept, each one's number of ids, all their ids in a row, and the last batch that had it.
        self.stems = pa.array([], pa.string())
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")
        self.used = np.zeros(0, np.int64)
        self.batches = 0

    def _split_letters(self) -> list[str]:
        """Letters whose ids no mark behind them changes. A letter whose lower case ends with a combining mark is
        none, as the mark joins those behind it. With another kind of tokenizer there may be no such letter, and
        words are looked up whole; \0 keeps the class from being empty."""
        def ids_of(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        alone = dict(zip([*LETTERS, *MARKS], ids_of([*LETTERS, *MARKS])))
        pairs = [(letter, mark) for letter in LETTERS for mark in MARKS]
        both = ids_of([letter + mark for letter, mark in pairs])
        joined = {letter for (letter, mark), ids in zip(pairs, both) if ids != alone[letter] + alone[mark]}
        return [letter for letter in LETTERS if letter not in joined] or ["\\x00"]

    def _places(self, stems: pa.Array) -> np.ndarray:
        """Where each stem is among those kept; new ones are encoded and added. Arrow lists values in the order in
        which they first occur, so the stems kept before stay where they are."""
        if len(self.stems) > CACHE_STEMS // 2:
            self._forget()
        n = len(self.stems)
        coded = pa.concat_arrays([self.stems, stems]).dictionary_encode()
        self.stems = coded.dictionary
        places = coded.indices.to_numpy()[n:]
        new = self.stems.slice(n)
        if len(new):
            letters = pc.match_substring_regex(new, pattern=self.letters).to_numpy(zero_copy_only=False)
            found = [(np.flatnonzero(letters), self._together), (np.flatnonzero(~letters), self._apart)]
            at, ids, lengths = [], [self.ids], []
            for of, encode in found:
                for first in range(0, len(of), 4096):
                    at.append(of[first : first + 4096])
                    more, n_each = encode(new.take(pa.array(at[-1])))
                    ids.append(more)
                    lengths.append(n_each)
            # Letters and others were encoded apart; their ids go back in the order of the stems.
            at, lengths = np.concatenate(at), np.concatenate(lengths)
            back = np.argsort(at)
            self.ids = np.concatenate([self.ids, _gather(np.concatenate(ids[1:]), lengths, back)])
            self.lengths = np.concatenate([self.lengths, lengths[back]])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.batches += 1
        self.used[places] = self.batches
        return places

    def _forget(self) -> None:
        """Keep the stems of the last batches, a quarter of CACHE_STEMS or fewer, but for those of the last one."""
        least = min(np.partition(self.used, -(CACHE_STEMS // 4))[-(CACHE_STEMS // 4)] + 1, self.batches)
        kept = np.flatnonzero(self.used >= least)
        self.stems = self.stems.take(pa.array(kept))
        self.ids = _gather(self.ids, self.lengths, kept)
        self.lengths, self.used = self.lengths[kept], self.used[kept]

    def _apart(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all stems in a row, and each one's number of ids."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(stems.to_pylist(), add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(encoded), "<u4"), np.fromiter(map(len, encoded), np.int64, len(encoded))

    def _together(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Stems of letters are one word each, so in one text their last tokens tell them apart."""
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(stems)], stems), " ")[0].as_py()
        encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        ids = np.asarray(encoded[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(stems):
            return self._apart(stems)
        return ids, np.diff(ends, prepend=0)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and each text's number of ids."""
        spaced = pc.replace_substring(pc.fill_null(texts, ""), pattern="\n", replacement=" ")
        pieces = pc.split_pattern(spaced, pattern=" ")
        words = pieces.flatten().dictionary_encode()
        distinct = words.dictionary
        body = pc.utf8_rtrim(distinct, characters=MARKS)
        split = pc.match_substring_regex(body, pattern=self.letters)
        mark = _ends(distinct, body)
        stem = pc.if_else(split, pc.ascii_lower(body), distinct)
        mark = pc.if_else(split, mark, "")
        # Each distinct word is two entries: its stem, and its mark or nothing.
        halves = self._places(pa.concat_arrays([stem, mark])).reshape(2, -1).T
        word_ids = _gather(self.ids, self.lengths, halves.reshape(-1))
        word_lengths = self.lengths[halves].sum(axis=1)
        order = words.indices.to_numpy()
        out = _gather(word_ids, word_lengths, order)
        ends = np.concatenate([[0], np.cumsum(word_lengths[order])])
        return out, np.diff(ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()])


def _ends(words: pa.Array, starts: pa.Array) -> pa.Array:
    """What follows each start in its word."""
    lengths = [pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, starts)]
    first = int(np.frombuffer(words.buffers()[1], np.int32)[words.offset]) if len(words) else 0
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[first : first + lengths[0].sum()]
    place = _gather(np.arange(len(data)), np.stack([lengths[1], lengths[0] - lengths[1]], axis=1).reshape(-1), np.arange(len(words)) * 2 + 1)
    ends = np.append(0, np.cumsum(lengths[0] - lengths[1])).astype(np.int32)
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(ends), pa.py_buffer(data[place].tobytes()))


def _gather(values: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that have these lengths, concatenated in the given order."""
    starts = np.cumsum(lengths) - lengths
    chosen = lengths[order]
    shift = starts[order] - (np.cumsum(chosen) - chosen)
    return values[np.arange(chosen.sum()) + np.repeat(shift, chosen)]


ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, as long as Spark reuses it."""
    if path not in ENCODERS:
        ENCODERS[path] = WordEncoder(path)
    return ENCODERS[path]


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, share: float = 0.9,
) -> None:
    """Encode ``text`` of every row and write the file rows below ``path``.

    Only ``doc_id`` and ``text`` are read. ``tokenizer`` is a file each worker can read. The rows are
    dealt out by ranges of the id, and of a hash of the text within an id, so one id cannot fill a
    task.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        part, seq, held, n = TaskContext.get().partitionId(), 0, [], 0

        def row():
            run = np.concatenate([ids for _, _, ids in held])
            columns = {
                "part": part, "seq": seq, "doc_ids": [d for ids, _, _ in held for d in ids],
                "n_tokens": np.concatenate([lengths for _, lengths, _ in held]),
                "n_ids": len(run), **pack_blocks(run, share),
            }
            return pa.RecordBatch.from_pylist([columns], schema=_arrow(FILE_SCHEMA))

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                piece = batch.slice(at, BATCH_DOCS)
                doc_ids = piece.column("doc_id").to_pylist()
                ids, lengths = encoder.encode(piece.column("text"))
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                lengths = lengths + 1
                ends = np.cumsum(lengths)
                first = 0
                while first < len(lengths):
                    before = ends[first] - lengths[first]
                    last = int(np.searchsorted(ends, before + ROW_IDS - n)) + 1
                    last = min(last, len(lengths))
                    held.append((doc_ids[first:last], lengths[first:last], ids[before : ends[last - 1]]))
                    n += int(ends[last - 1] - before)
                    if n >= ROW_IDS:
                        yield row()
                        seq, held, n = seq + 1, [], 0
                    first = last
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "_tie")
    rows = rows.sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    rows.mapInArrow(encode, FILE_SCHEMA).write.parquet(path)


def _arrow(schema: str) -> pa.Schema:
    kinds = {
        "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(),
        "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    }
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in schema.split(", "))])


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    schema = IDS_SCHEMA if with_ids else DIGEST_SCHEMA

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_blocks(row["n_ids"], row)
                n = np.asarray(row["n_tokens"], np.int64)
                place = np.cumsum(n) - n
                documents = [ids[a : a + k] for a, k in zip(place, n)]
                last = (
                    pa.array([d.astype(np.int32) for d in documents], pa.list_(pa.int32()))
                    if with_ids
                    else pa.array([zlib.crc32(d.tobytes()) for d in documents], pa.int64())
                )
                same = len(documents)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * same, pa.int32()),
                        pa.array([row["seq"]] * same, pa.int32()),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(place), pa.array(n), last,
                    ],
                    schema=_arrow(schema),
                )

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # Ids before each file row: those of earlier parts, one total each, and of the part's earlier rows.
    sizes = files.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(parts, "part").select(
        "part", "seq", (F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base")
    )
    rows = files.mapInArrow(decode, schema).join(offsets, ["part", "seq"])
    return rows.withColumn("start", F.col("base") + F.col("place")).drop("part", "seq", "base", "place")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``start``, the number of ids of all documents before."""
    return _read(spark, path, True)


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_crc32`` and ``start``, all of them from the files."""
    return _read(spark, path, False)
