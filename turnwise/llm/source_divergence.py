"""How a language's sources differ in the terms they use, over the terms that enough documents hold.

1.  *Iceberg prefix refinement.* Terms are cut to their first 4 bytes, and the distinct documents of each
    (language, prefix) are counted. Prefixes below the threshold are discarded with all terms below them.
    Prefixes shorter than the cut are complete terms with their exact count; the others grow to 12, 36, ...
    bytes, until only complete terms are left. Rare terms so leave while they are still part of a
    short prefix, and before any term is exchanged. A document's equal prefixes follow each other and count
    once, and counts combine before each exchange, so a prefix that all documents hold is one row a task.
    Postings of one source that agree in the term and in what it shares with the document's term before are
    combined before they are written.
2.  *Between levels* the kept prefixes are a bit table that grows with their number. It only saves work:
    each level counts again, so a prefix that passes by chance is discarded then.
3.  *Occurrences* of kept terms are counted by (language, source, term). From them follow the shares of
    each source and language, in whole parts of a milliard.
4.  *Pairs of sources* are summed in blocks of terms and tiles of sources, as matrix products are. A term that
    neither source has gives a pair the same value each time, so blocks hold only terms that occur.

Null text, language and source are ''. Each row is a document of its own, repeated ones too. A language
without kept terms has pairs of value 0. Only the four named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.llm.common import stored

#: A-Z in lower case, all that is no letter as a space; bytes from 128 on belong to letters.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of two terms that are compared at once.
HEAD = 40
#: Bytes of text whose terms a worker counts together, whose postings it combines, and rows it hands over.
BATCH_BYTES = 1 << 22
COMBINED_BYTES = 1 << 25
BATCH_ROWS = 1 << 17
MIN_DOCUMENTS = 3
#: Bytes of the first prefixes, and how much longer those of the next level are.
FIRST_BYTES = 4
GROWTH = 3
#: Parts that a share is counted in.
PARTS = 1_000_000_000
#: Bits a prefix, and the largest table: beyond it more prefixes pass by chance, to be counted again.
BITS_PER_PREFIX = 16
MAX_BITS = 1 << 27
CHUNK_WORDS = 4096
#: Sources of a tile, counted rows of a block of terms, terms that are handled at once.
TILE = 128
BLOCK_ROWS = 1 << 16
STEP = 2048
TOP_TERMS = 200


def _common_prefixes(terms: list[bytes], firsts: list[int]) -> np.ndarray:
    """How many bytes each term shares with the one before; -1 at the places in ``firsts``."""
    shared = np.full(len(terms), -1, np.int32)
    if len(terms) > 1:
        heads = np.array(terms, f"S{HEAD}").view(np.uint8).reshape(len(terms), HEAD)
        differ = heads[1:] != heads[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), HEAD)
    shared[firsts] = -1
    for at in np.flatnonzero(shared == HEAD).tolist():
        shared[at] = len(commonprefix(terms[at - 1 : at + 1]))
    return shared


def _combined(held: list[pa.Table], groups: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    """The rows of ``held`` that agree in all but ``n`` as one, with how many documents they are from."""
    keys = ["group", "term", "shared"]
    table = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum"), ([], "count_all")])
    of = table.column("group").combine_chunks()
    names = [pa.array(column, pa.string()).take(of) for column in zip(*groups)]
    columns = [*names, *(table.column(c) for c in ("term", "n_sum", "count_all", "shared"))]
    yield from pa.table(columns, ["lang", "source", "term", "n", "documents", "shared"]).to_batches(BATCH_ROWS)


def postings_of(docs: DataFrame) -> DataFrame:
    """The distinct terms of each row of ``docs``: ``lang``, ``source``, ``term`` (its bytes), ``n`` (occurrences),
    ``documents`` and ``shared`` (bytes it has in common with the document's term before, -1 for the
    first). A row stands for as many documents of a task as agree in all but ``n``, which is their sum. Documents
    without terms have a null term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held, held_bytes = [], 0
        for batch in batches:
            names = zip(*(batch.column(i).to_pylist() for i in (0, 1)))
            size, terms, counts, sizes, of = 0, [], [], [], []
            for at, (name, text) in enumerate(zip(names, batch.column(2).cast(pa.binary()))):
                data = text.as_py()
                found = Counter(data.translate(_LETTERS).split()) or {None: 0}
                order = sorted(found) if len(found) > 1 else list(found)
                terms += order
                counts += map(found.__getitem__, order)
                sizes.append(len(order))
                of.append(groups.setdefault(name, len(groups)))
                size += len(data)
                if size < BATCH_BYTES and at + 1 < batch.num_rows:
                    continue
                firsts = np.cumsum([0, *sizes[:-1]]).tolist()
                shared = _common_prefixes([term or b"" for term in terms], firsts)
                columns = [np.repeat(np.array(of, np.int32), sizes), pa.array(terms, pa.binary()), pa.array(counts, pa.int64()), shared]
                held.append(pa.table(columns, ["group", "term", "n", "shared"]))
                held_bytes += size
                size, terms, counts, sizes, of = 0, [], [], [], []
                if held_bytes >= COMBINED_BYTES:
                    yield from _combined(held, groups)
                    groups, held, held_bytes = {}, [], 0
        if held:
            yield from _combined(held, groups)

    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)
    rows = docs.select(blank("lang"), blank("source"), blank("text"))
    return rows.mapInArrow(counted, "lang string, source string, term binary, n bigint, documents bigint, shared int")


class BitTable:
    """A set of (language, prefix) as one row of bits, read as a scalar subquery."""

    def __init__(self, prefixes: DataFrame, width: int | None, size: int):
        self.width = width
        self.bits = 1024
        while self.bits < min(size * BITS_PER_PREFIX, MAX_BITS):
            self.bits *= 2
        ones = prefixes.select(self._place(F.col("lang"), F.col("prefix")).alias("place")).select(
            F.expr("shiftright(place, 6)").alias("word"), F.expr("shiftleft(1L, int(place % 64))").alias("bits")
        )
        zeros = prefixes.sparkSession.range(self.bits // 64).select(
            F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits")
        )
        words = ones.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        chunks = words.groupBy(F.expr(f"word div {CHUNK_WORDS}").alias("chunk")).agg(
            F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("words")
        )
        self.row = stored(
            chunks.agg(F.array_sort(F.collect_list(F.struct("chunk", "words")))["words"].alias("words")), "bits"
        )

    def _place(self, lang: Column, prefix: Column) -> Column:
        return F.pmod(F.xxhash64(lang, prefix), F.lit(self.bits))

    def holds(self, lang: Column, term: Column) -> Column:
        place = self._place(lang, term if self.width is None else F.substring(term, 1, self.width))
        chunk = F.get(self.row.scalar(), (place / (64 * CHUNK_WORDS)).cast("int"))
        word = F.get(chunk, ((place / 64).cast("bigint") % CHUNK_WORDS).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, (place % 64).cast("int"))
        return bit.bitwiseAND(F.lit(1)) == 1


def _prefixes(postings: DataFrame, width: int, table: BitTable | None) -> DataFrame:
    """(``lang``, ``prefix``, ``documents``): documents' distinct prefixes that the level before kept.

    A document's terms are in order, so a prefix is new where less than its width is shared with the term
    before; and of the terms of a prefix, all were kept by the level before or none.
    """
    rows = postings.filter(F.col("term").isNotNull() & (F.col("shared") < width))
    if table is not None:
        rows = rows.filter((F.length("term") >= table.width) & table.holds(F.col("lang"), F.col("term")))
    return rows.select("lang", F.substring("term", 1, width).alias("prefix"), "documents")


def kept_terms(postings: DataFrame, least: int = MIN_DOCUMENTS, first: int = FIRST_BYTES) -> DataFrame:
    """(``lang``, ``term``) of the terms in at least so many of the language's documents."""
    width, complete, table = first, [], None
    while True:
        counted = _prefixes(postings, width, table).groupBy("lang", "prefix").agg(F.sum("documents").alias("documents"))
        level = stored(counted.filter(F.col("documents") >= least).select("lang", "prefix"), "level")
        complete.append(level.filter(F.length("prefix") < width).withColumnRenamed("prefix", "term"))
        open_ones = level.filter(F.length("prefix") == width)
        size = open_ones.count()
        if not size:
            return reduce(DataFrame.unionByName, complete)
        table = BitTable(open_ones, width, size)
        width *= GROWTH


def _share(count: str, total: str) -> Column:
    """1 + floor(PARTS * (count + 1) / (total + kept)), exactly: in long integers while these suffice."""
    return F.expr(
        f"1 + CASE WHEN {count} < {(1 << 62) // PARTS} THEN ({count} + 1) * {PARTS} div ({total} + kept)"
        f" ELSE (CAST({count} + 1 AS DECIMAL(20,0)) * {PARTS}) div ({total} + kept) END"
    )


def _excess(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _block_sums(table: pa.Table, tile: int, step: int) -> pa.Table:
    """Of one block of terms and two tiles of sources: for each pair of sources, the sum over the block's
    terms of what the pair's value exceeds that of a term neither has. Rows without a term tell the sources."""
    column = {name: table.column(name).combine_chunks() for name in table.column_names}
    own = column["term"].is_null().to_numpy(zero_copy_only=False)
    source, share = column["number"].to_numpy(), column["share"].to_numpy()
    order = np.argsort(source[own])
    sources, base = source[own][order], share[own][order]
    terms = column["term"].filter(pa.array(~own)).dictionary_encode().indices.to_numpy()
    at, share = np.searchsorted(sources, source[~own]), share[~own]
    by_term = np.argsort(terms, kind="stable")
    terms, at, share = terms[by_term], at[by_term], share[by_term]
    low, high = (column[name][0].as_py() for name in ("low", "high"))
    tiles = sources // tile
    sides = [(np.flatnonzero(tiles == a), np.flatnonzero(tiles == b)) for a, b in {(low, high), (high, low)}]
    nothing = (base[:, None] - base[None, :]) ** 2 // base[None, :]
    sums = np.zeros((len(sources), len(sources)), np.int64)
    n_terms = int(terms[-1]) + 1 if len(terms) else 0
    for begin in range(0, n_terms, step):
        a, b = np.searchsorted(terms, [begin, begin + step])
        shares = np.repeat(base[:, None], min(step, n_terms - begin), axis=1)
        shares[at[a:b], terms[a:b] - begin] = share[a:b]
        for rows, columns in sides:
            other = shares[columns]
            for row in rows.tolist():
                gap = shares[row] - other
                sums[row, columns] += (gap * gap // other - nothing[row, columns, None]).sum(axis=1)
    pairs = [np.stack([x.ravel() for x in np.meshgrid(rows, columns, indexing="ij")]) for rows, columns in sides]
    one, two = np.concatenate(pairs, axis=1)
    one, two = one[one != two], two[one != two]
    return pa.table(
        {
            "lang": pa.array([column["lang"][0].as_py()] * len(one), pa.string()),
            "one": sources[one], "two": sources[two], "extra": sums[one, two],
        }
    )


def _pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(``lang``, ``one``, ``two``, ``extra``) over all blocks."""
    blocks = max(1, -(-counts.count() // BLOCK_ROWS))
    rows = counts.select("lang", "number", "tiles", "share", "term", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    every = groups.select(
        "lang", "number", "tiles", F.col("base").alias("share"), F.lit(None).cast("binary").alias("term"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
    )
    tile = F.expr(f"number div {TILE}")
    sent = rows.unionByName(every).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)))
    sent = sent.select(
        "lang", "block", F.least(tile, "other").alias("low"), F.greatest(tile, "other").alias("high"),
        "number", "share", "term",
    )
    size, step = TILE, STEP

    def block_sums(table: pa.Table) -> pa.Table:
        return _block_sums(table, size, step)

    sums = sent.groupBy("lang", "block", "low", "high").applyInArrow(
        block_sums, "lang string, one bigint, two bigint, extra bigint"
    )
    return sums.groupBy("lang", "one", "two").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair`` has the divergence of each source from each other one of its language, part ``term`` the
    ``top`` terms that a source uses more than its language does.
    """
    postings = stored(postings_of(docs), "postings")
    kept = stored(kept_terms(postings, least), "kept")
    table = BitTable(kept.withColumnRenamed("term", "prefix"), None, kept.count())
    used = postings.filter(F.col("term").isNotNull() & table.holds(F.col("lang"), F.col("term")))
    used = used.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    of_lang = Window.partitionBy("lang", "term")
    # What passed by chance is in too few documents here as well.
    used = used.select("lang", "source", "term", "n", F.sum("n").over(of_lang).alias("lang_n"), F.sum("documents").over(of_lang).alias("documents"))
    used = stored(used.filter(F.col("documents") >= least).drop("documents"), "used")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = postings.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select(
        "lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"),
        (F.row_number().over(by_source) - 1).cast("bigint").alias("number"),
    )
    groups = groups.withColumn("base", F.when(F.col("kept") > 0, _share("0", "total")))
    tiles = F.expr(f"1 + (max(number) OVER (PARTITION BY lang)) div {TILE}")
    lang_total = F.sum("total").over(Window.partitionBy("lang"))
    groups = stored(groups.withColumns({"tiles": tiles, "lang_total": lang_total}), "groups")
    shares = used.join(groups.drop("base"), ["lang", "source"]).withColumn("share", _share("n", "total"))
    sums = _pair_sums(shares, groups.filter(F.col("kept") > 0))
    ones = groups.select("lang", "kept", "source", F.col("number").alias("one"), F.col("base").alias("p"))
    twos = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("two"), F.col("base").alias("q"))
    pairs = ones.join(twos, "lang").filter(F.col("one") != F.col("two")).join(sums, ["lang", "one", "two"], "left")
    value = F.coalesce(F.col("kept") * _excess("p", "q") + F.col("extra"), F.lit(0)).alias("value")
    pairs = _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value))

    terms = shares.withColumn("mean", _share("lang_n", "lang_total"))
    terms = terms.filter(F.col("share") > F.col("mean")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
        _excess("share", "mean").alias("value"),
    )
    return pairs.unionByName(_ranked(terms).filter(F.col("rank") <= top))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))
