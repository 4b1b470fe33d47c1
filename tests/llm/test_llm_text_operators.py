from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.llm import fragment_join, kneser_ney, suffix_dedup, token_blocks
from turnwise.llm.decontamination import find_leaks, remove_spans
from turnwise.llm.fragment_join import similar_documents
from turnwise.llm.secrets import report, scan_secrets

from .conftest import texts_of


# --- token files -----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
@pytest.mark.parametrize("high", [1, 2, 50_000, 2**32 - 1])
def test_blocks_round_trip(n, high):
    ids = np.random.default_rng(n).integers(0, high, n).astype("<u4")
    assert (token_blocks.unpack_blocks(n, token_blocks.pack_blocks(ids)) == ids).all()


def test_outliers_are_exceptions():
    ids = np.zeros(128, "<u4") + 7
    ids[5] = 1 << 20
    parts = token_blocks.pack_blocks(ids, 0.9)
    assert parts["widths"] == b"\0" and len(parts["exception_values"]) == 4


def test_token_files(spark, odd_docs, no_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    token_blocks.write_token_files(odd_docs, str(tmp_path / "a"), path)
    got = [(r.doc_id, r.start, r.ids) for r in token_blocks.read_token_files(spark, str(tmp_path / "a")).collect()]
    want = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts_of(odd_docs)]
    assert sorted((str(i), ids) for i, _, ids in got) == sorted((str(i), ids) for i, ids in want)
    # Starts are where the documents in ascending order of their ids begin; null ids come first.
    at = 0
    for doc_id, start, ids in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += len(ids)
    in_order = [i for i, _, _ in sorted(got, key=lambda r: r[1]) if i is not None]
    assert in_order == sorted(in_order)
    digests = {(r.start, r.ids_crc32) for r in token_blocks.read_token_digests(spark, str(tmp_path / "a")).collect()}
    assert digests == {(s, zlib.crc32(np.array(ids, "<u4").tobytes())) for _, s, ids in got}
    token_blocks.write_token_files(no_docs, str(tmp_path / "b"), path)
    assert token_blocks.read_token_files(spark, str(tmp_path / "b")).count() == 0


# --- secrets -----------------------------------------------------------------------------------------


def test_secrets(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in report(scan_secrets(odd_docs, "doc_id", "source")).collect()}
    assert (got[10].n_assign, got[10].n_access, got[10].spans) == (1, 1, "assign:0:17,access:18:38")
    assert got[10].base_sha256 == hashlib.sha256(b"assign:0:17,access:18:38").hexdigest()
    assert got[11].n_assign == 0 and got[3].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert report(scan_secrets(odd_docs, "doc_id", "source")).count() == odd_docs.count()
    assert report(scan_secrets(no_docs, "doc_id", "source")).count() == 0


def test_secrets_of_many_owners_are_copied(spark):
    rows = [(i, f"x password=example{i % 2}value Bearer abcdefghijklmnop{i % 2}", f"o{i if i % 2 else 0}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    got = {r.doc_id: r for r in report(scan_secrets(docs, "doc_id", "source")).collect()}
    assert got[0].n_live == 2 and "bearer" in got[0].spans  # one owner
    assert got[1].n_copied == 2 and "bearer" not in got[1].spans and got[1].n_assign == 1  # four owners


def key_block(body, kind="RSA "):
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"


def test_private_keys_are_told_apart_by_their_body(spark):
    line = lambda c: c * 64 + "\n" + c.upper() * 20 + "=="
    own = [f"see {key_block(line(c))} end" for c in "abcd"]
    copied = [f"{'x' * k} {key_block(line('z').replace(chr(10), end))}" for k, end in enumerate(["\n", "\r\n", "\\n"])]
    fields = key_block("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n" + line("q"))
    cut = f"-----BEGIN PRIVATE KEY-----\n{line('e')[:80]}"
    two = key_block(line("m"), "") + "\n" + key_block(line("n"), "EC ")
    bare = "-----BEGIN PRIVATE KEY----- is a header"
    long = key_block("\n".join("k" * 64 for _ in range(3000)) + "-k" * 50_000)
    texts = [*own, *copied, fields, cut, two, bare, long]
    docs = spark.createDataFrame([(i, t, f"o{i}") for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, source STRING")
    got = {r.doc_id: r for r in report(scan_secrets(docs, "doc_id", "source")).collect()}
    spans = lambda i: [s for s in got[i].spans.split(",") if s.startswith("private")]
    for i, text in enumerate(own):
        assert spans(i) == [f"private:4:{len(text) - 4}"]  # four owners of the header, one of the key
    assert [spans(i) for i in (4, 5, 6)] == [[], [], []] and got[4].n_copied == 1  # three owners of one key
    assert spans(7) == [f"private:0:{len(fields)}"] and spans(8) == [f"private:0:{len(cut)}"]
    middle = two.index("\n-----BEGIN")
    assert spans(9) == [f"private:0:{middle}", f"private:{middle + 1}:{len(two)}"]
    assert spans(10) == ["private:0:27"] and spans(11) == [f"private:0:{len(long)}"]


# --- decontamination ---------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [200_000, 0])
def test_leaks(spark, odd_docs, no_docs, most):
    item = " ".join(f"Word{i}, OF" for i in range(10, 20))
    bench = spark.createDataFrame(
        [(1, item), (2, "one TWO"), (3, None), (4, "..."), (5, item)], "item_id BIGINT, text STRING"
    )
    got = {r.doc_id: r for r in find_leaks(odd_docs, bench, max_set=most).collect() if r.doc_id is not None}
    assert got[1]["items"] == ["1", "5"] and len(got[1].hit) == 20 and got[1].hit[0] == 20
    assert got[7]["items"] == ["2"] and got[7].hit == [0, 1] and got[6].hit == []
    assert got[3].n_words == 0 and got[12].n_words == 1
    assert find_leaks(odd_docs, bench, max_set=most).count() == odd_docs.count()
    assert find_leaks(no_docs, bench, max_set=most).count() == 0
    assert find_leaks(odd_docs, bench.limit(0), max_set=most).filter(F.size("hit") > 0).count() == 0


def test_hit_words_are_removed(spark):
    docs = spark.createDataFrame([("Keep This, drop it. End",)], "text STRING")
    row = docs.select(remove_spans(F.col("text"), F.array(F.lit(2), F.lit(3))).alias("t")).first()
    assert row.t == "Keep This, End"


# --- n-gram join -------------------------------------------------------------------------------------


def shingle_set(text, size):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(texts, size, percent):
    sets = [shingle_set(t, size) for _, t in texts]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                parent[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(texts):
        least[top(i)].append(doc_id)
    return sorted(
        (str(doc_id), len(sets[i]), str(min((x for x in least[top(i)] if x is not None), default=None)))
        for i, (doc_id, _) in enumerate(texts)
    )


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (2, 50)])
def test_fragment_join_of_odd_texts(spark, odd_docs, size, percent):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_documents(odd_docs, size, percent).collect())
    assert got == brute_components(texts_of(odd_docs), size, percent)


@pytest.mark.parametrize("size,percent,least", [(3, 90, 9), (5, 80, 4), (2, 50, 1), (3, 100, 9)])
def test_fragment_join_of_sets_with_one_ngram_more(spark, size, percent, least):
    """A set links with one that has all its n-grams and one more, from the least size on that allows it."""
    texts = []
    for n in range(1, least + 3):
        words = [f"n{n}w{k}" for k in range(n + size - 1)]
        for more in ([], ["before"], None):
            copy = [*words, "after"] if more is None else [*more, *words]
            texts.append((len(texts), " ".join(copy)))
        # The same sets from long texts that repeat themselves.
        texts.append((len(texts), " ".join(f"r{n}w{k % n}" for k in range(50 * n + size))))
        texts.append((len(texts), texts[-1][1] + " last"))
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_documents(docs, size, percent).collect())
    assert got == brute_components(texts, size, percent)


def test_fragment_join_of_near_copies_in_long_lists(spark, no_docs, monkeypatch):
    """Groups of near copies of which only some pairs link, in posting lists and tiles of several parts."""
    monkeypatch.setattr(fragment_join, "LIST_ROWS", 8)
    monkeypatch.setattr(fragment_join, "TILE_DOCS", 4)
    rng = np.random.default_rng(3)
    texts = []
    for group in range(3):
        words = [f"g{group}w{k}" for k in range(120)]
        for copy in range(40):
            changed = list(words)
            for place in rng.choice(120, rng.integers(0, 5), replace=False):
                changed[place] = f"c{group}x{copy}y{place}"
            texts.append((len(texts), " ".join(changed)))
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar_documents(docs, 3, 90).collect())
    assert got == brute_components(texts, 3, 90)
    assert similar_documents(no_docs).count() == 0


# --- suffix array ------------------------------------------------------------------------------------


def test_suffix_array(spark):
    import bisect

    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 3, rng.integers(1, 40)).tolist() for _ in range(30)] + [[1] * 25, [1] * 24, [2]]
    df = spark.createDataFrame(list(enumerate(texts)), "piece BIGINT, values ARRAY<BIGINT>")
    got = {r["piece"]: r["values"] for r in suffix_dedup.rank_suffixes(df).collect()}
    suffixes = sorted(tuple(t[i:]) for t in texts for i in range(len(t)))
    assert got == {k: [bisect.bisect_left(suffixes, tuple(t[i:])) for i in range(len(t))] for k, t in enumerate(texts)}


def brute_removed(texts):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(d[i : i + 400] for d in data for i in range(len(d) - 399))
    out = []
    for (doc_id, _), d in zip(texts, data):
        covered = bytearray(len(d))
        for i in range(len(d) - 399):
            if seen[d[i : i + 400]] > 1:
                covered[i : i + 400] = b"\1" * 400
        spans = sum(c and not p for c, p in zip(covered, b"\0" + covered[:-1])) if d else 0
        kept = bytes(b for b, c in zip(d, covered) if not c)
        out.append((str(doc_id), len(d), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeated_bytes(spark, odd_docs, no_docs):
    rng = np.random.default_rng(5)
    random = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    shared, other = random(900), random(405)
    texts = [(i, t if t is None else t[:3000]) for i, t in texts_of(odd_docs)]
    texts += [
        (20, random(300) + shared + random(50)), (21, shared[10:700] + random(500)), (22, random(10) + other), (23, other + random(9) + other[:401]),
        (24, "ab" * 700), (25, other[:399]), (26, random(700) + "ä" * 210 + shared[200:650]), (27, random(5000)),
    ]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs).collect())
    assert got == brute_removed(texts)
    assert suffix_dedup.repeated_bytes(no_docs).count() == 0


def test_suffix_array_of_keys_over_many_batches(spark):
    """Most triples are one key, and keys and pieces go on over batches and ranges."""
    import bisect

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        texts = [[5] * n for n in (1, 2, 3, 9, 30, 31, 31)] + [[5, 4], [5, 5, 6], [4] + [5] * 20]
        df = spark.createDataFrame(list(enumerate(texts)), "piece BIGINT, values ARRAY<BIGINT>")
        got = {r["piece"]: r["values"] for r in suffix_dedup.rank_suffixes(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    suffixes = sorted(tuple(t[i:]) for t in texts for i in range(len(t)))
    assert got == {k: [bisect.bisect_left(suffixes, tuple(t[i:])) for i in range(len(t))] for k, t in enumerate(texts)}


def test_repeated_bytes_of_structured_texts_in_small_batches(spark, monkeypatch):
    """Thue-Morse texts, and a passage in a third of all rows with other bytes around it."""
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", 5)
    rng = np.random.default_rng(9)
    random = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    passage = random(640)
    texts = [(0, morse), (1, morse.translate(str.maketrans("ab", "ba"))), (2, morse[:512] + random(300)), (3, random(90) + morse[100:700])]
    texts += [(10 + i, random(60 + i) + passage[i % 7 :] + random(80)) for i in range(20)]
    texts += [(40 + i, random(700)) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == brute_removed(texts)


def test_repeated_bytes_of_an_id_with_two_texts(spark):
    rng = np.random.default_rng(8)
    random = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    shared = random(450)
    a, b = random(900), random(200) + shared + random(150) + shared
    texts = [(3, a), (5, a), (5, b), (6, random(100) + b[300:900]), (7, random(700))]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs).collect())
    assert got == brute_removed(texts)


def test_windows_that_touch_leave_as_one_span(spark, monkeypatch):
    """And texts are cut and described alike one by one and together."""
    rng = np.random.default_rng(12)
    random = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    shared = random(1500)
    texts = [(i, random(300 + i) + shared[3 * i : 1400 + 7 * i] + random(40 * i)) for i in range(9)]
    texts += [(20, "é" * 900), (21, "-" * 1500), (22, random(399)), (23, random(400)), (24, texts[3][1][250:900])]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    compare, rows = suffix_dedup.compare_neighbours, []

    def counted(pieces, ranks):
        found = suffix_dedup.stored(compare(pieces, ranks), "found")
        rows.append(found.selectExpr("count(*) AS n", "sum(high - low + 1) AS windows").first())
        return found

    monkeypatch.setattr(suffix_dedup, "compare_neighbours", counted)
    for size in (1, 1 << 18):
        monkeypatch.setattr(suffix_dedup, "TEXT_BYTES", size, raising=False)
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_bytes(docs).collect())
        assert got == brute_removed(texts)
    assert rows[0].windows == rows[1].windows > 100
    assert all(4 * r.n < r.windows for r in rows)


# --- language model ----------------------------------------------------------------------------------


def tokens_of(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w] + ["end"]


def test_pair_model(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text").union(
        spark.createDataFrame([(50 + i, f"the cat sat on the mat {i % 3} a b c d the {'x' * (i % 4)}") for i in range(40)], "doc_id BIGINT, text STRING")
    )
    held_out = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    model = kneser_ney.train(docs.filter(~held_out), spark)
    rows = kneser_ney.score_documents(docs, held_out, model).collect()
    texts = texts_of(docs)
    training = [tokens_of(t) for i, t in texts if i is None or i % 3]
    words, pairs = Counter(w for t in training for w in t), Counter()
    for text in training:
        pairs.update(zip(["start", *text], text))
    of = lambda counts: kneser_ney.discounts([sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)])
    before = Counter(w for _, w in pairs)
    d2, d1 = of(pairs), of(before)
    total, spared = Counter(), Counter()
    for (v, _), n in pairs.items():
        total[v] += n
        spared[v] += d2[min(n, 3) - 1]
    rest = sum(d1[min(n, 3) - 1] for n in before.values()) / len(pairs)
    cut = lambda n, d: n - d[min(n, 3) - 1] if n else 0
    n_all, n_words = sum(words.values()), len(words)

    def chance(v, w):
        single = cut(before[w], d1) / len(pairs) + rest / (n_words + 1)
        return cut(pairs[v, w], d2) / total[v] + spared[v] / total[v] * single if total[v] else single

    assert math.isclose(sum(chance(b"the", w) for w in words) + chance(b"the", "unknown"), 1)
    want = sorted(
        (
            str(i), len(t), sum(words[w] > 0 for w in t),
            round(sum(math.log10((words[w] + 1) / (n_all + n_words + 1)) for w in t), 6),
            round(sum(math.log10(chance(v, w)) for v, w in zip(["start", *t], t)), 6),
        )
        for i, t in ((i, tokens_of(t)) for i, t in texts)
    )
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=1e-4)
    assert {r.train_tokens for r in rows} == {n_all}
    empty = kneser_ney.train(no_docs, spark)
    assert [r.n_known for r in kneser_ney.score_documents(docs.limit(1), held_out, empty).collect()] == [0]


def test_private_keys_match_sql(spark, tmp_path):
    """Whole and cut keys, in one line and in several, with fields, without a body, and held by several owners."""
    import duckdb

    from check import compare
    from turnwise.llm.catalog import ORACLES, QUERIES

    line = lambda c: c * 64 + "\n"
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    texts = [f"key {begin}\n{line(c) * 3}{c}=\n{end} ." for c in "abcd"] + [f"{begin}\n{line('z') * 2}{end}"] * 4
    texts += [
        f"{begin}\n{line('e')}eee=\n rest", f"{begin}\n{line('f')}fff", f"{begin}\n{line('g')}ggg \n\t ", f"{begin} is a header",
        f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00  ", f"{begin}\nProc-Type: 4\n{line('h')}{end}",
        f"{begin}\\n{'i' * 64}\\n{'i' * 20}\\n{end}", f"{begin}{end}", f"{begin}\n{end}", f"{begin}a-b--c---d----e{end}",
        f"{begin}x------END RSA PRIVATE KEY-----", f"{begin}\n{line('j')}{begin}\n{line('k')}{end}", f"{begin}\n\x0b{line('l')}l==",
        f"{begin}\n{line('m')}mmm stop", "-----BEGIN PRIVATE KEY-----" * 3,
    ]
    rows = [(i, text, f"src{i}") for i, text in enumerate(texts)] + [(90, None, None), (91, "", "src1")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = QUERIES["op1_secret_ownership"](spark, str(tmp_path))
    assert found.filter("spans LIKE '%private%'").count() > 10
    assert compare(found, connection, ORACLES["op1_secret_ownership"]) is None


def test_ids_of_every_letter_before_every_mark():
    """And of random words of such letters and marks."""
    import random

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from turnwise.llm.token_blocks import LETTERS, MARKS, WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, plain = WordEncoder(path), Tokenizer.from_file(path)
    words = [letter + mark for letter in LETTERS for mark in MARKS] + ["TAKSİ.", "BELEDİYESİ,", "İ" * 30 + "!?"]
    rng = random.Random(4)
    pool = LETTERS + list(MARKS) + list("  \n\té́̇日本0123456789  ß\U0001f600")
    words += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    ids, sizes = encoder.encode(pa.array(words))
    expected = [e.ids for e in plain.encode_batch_fast(words, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, expected))
    assert ids.tolist() == [i for own in expected for i in own]


def test_stems_kept_are_no_python_objects(monkeypatch):
    """The encoder looks stems up in Arrow; and ids stay right when it forgets stems between batches."""
    import random
    import sys

    import public_tokenizers
    import pyarrow as pa

    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdeñé") for _ in range(9)) + rng.choice(["", ".", "ı́", "7"]) for _ in range(30_000)})
    encoder = token_blocks.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = pa.array([" ".join(words[i : i + 50]) for i in range(0, len(words), 50)])
    encoder.encode(texts[:1])
    before = sys.getallocatedblocks()
    ids, sizes = encoder.encode(texts)
    assert sys.getallocatedblocks() - before < len(words) // 10
    expected = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, expected))
    assert ids.tolist() == [i for own in expected for i in own]
    monkeypatch.setattr(token_blocks, "CACHE_STEMS", 4000)
    for at in (0, 20, 10, 300, 0, 310, 20, len(texts) - 5):
        ids, sizes = encoder.encode(texts[at : at + 30])
        assert ids.tolist() == [i for own in expected[at : at + 30] for i in own]
        assert sizes.tolist() == list(map(len, expected[at : at + 30]))
    assert len(encoder.stems) < 6000


def test_packed_bits_of_every_width():
    """Values lie bit after bit, the lowest first, in as many bits as the width."""
    rng = np.random.default_rng(3)
    for width in range(1, 33):
        values = rng.integers(0, 1 << width, (5, token_blocks.BLOCK), dtype=np.uint64)
        words = np.ascontiguousarray(token_blocks._pack(values, width))
        bits = np.unpackbits(words.view(np.uint8).reshape(5, -1), axis=1, bitorder="little").reshape(5, token_blocks.BLOCK, width)
        assert ((bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=2) == values).all()
        assert (token_blocks._unpack(words, width) == values).all()
