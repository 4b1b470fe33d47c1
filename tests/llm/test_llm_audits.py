"""Personal data, periodic runs and source divergence: SQL on odd rows, brute force, hand-made cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare
from turnwise.llm import periodic_runs, personal_data, source_divergence
from turnwise.llm.catalog import ORACLES, QUERIES, with_planted_periods

PERSONAL = [
    "mail a.b+c@mail1.example.com, x@y.z_q@r.st, @no.pe@ok.is, bad@nodot, " + "a" * 4000 + "@x",
    "ip 97.51.17.173 256.1.1.1 1.2.3.4.5 001.002.003.0255 1.2.3 " + "9" * 3000 + ".1.2.3",
    "cards 4111 1111 1111 1111 4111-1111-1111-1112 79927398713 4111111111111111 5500000000000004 " + "1 " * 3000,
    "call +1 (017) 555-7713 or +49 30 123456 or +1 (1) or +1234567890123456 ++",
    "account DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 DE88 3704 0044 0532 0130 00 XX12ABCDEFGHIJKLMNO",
    "AD1200012030200359100100 NL91ABNA0417164300 bank FR1420041010050500013M02606 DE89 3704 0044 0532 0130 00THE",
    "ssn 123-45-6789 and 000-12-3456 and 666-12-3456 and 123-00-4567 and 1123-45-6789",
    "phone 030 555-1234, (030) 555-1234; +1 (030) 555-1234 tel 030.555.1234 555-7209",
    "credit card 7536784127813050 4111111111111111 4845168114407329",
    "order 4111111111111111 visa", "Ünïcödé ☎ tel 030 555-1234 \U0001f600 a@b.cd", "sample isbn 123-45-6789 social",
]


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    """Odd rows, and texts with all kinds of personal data."""
    path = str(tmp_path_factory.mktemp("odd"))
    more = spark.createDataFrame(
        [(100 + i, text, "de" if i % 2 else None, f"src{i % 3}") for i, text in enumerate(PERSONAL)],
        "doc_id BIGINT, text STRING, lang STRING, source STRING",
    )
    odd_docs.unionByName(more, allowMissingColumns=True).coalesce(2).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["op11_personal_data", "op13_source_divergence"])
def test_odd_rows_match_sql(spark, folder, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert compare(QUERIES[name](spark, folder), connection, ORACLES[name]) is None


@pytest.mark.parametrize("name", ["op11_personal_data", "op12_periodic_runs", "op13_source_divergence"])
def test_empty_table(spark, no_docs, tmp_path, name):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def found(text):
    return [(personal_data.NAMES[s["rank"]], text[s["start"] : s["end"]], s["score"]) for s in personal_data.find_spans(text)]


def test_checksums_confirm_accounts():
    assert found("my bank account DE89 3704 0044 0532 0130 00") == [("iban", "DE89 3704 0044 0532 0130 00", 95)]
    assert found("my bank account DE88 3704 0044 0532 0130 00") == []
    assert found("GB82WEST12345698765432 FURTHER") == [("iban", "GB82WEST12345698765432", 70)]
    assert found("sample IBAN GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432", 70)]


def test_context_moves_scores():
    assert found("x 4111111111111111 y") == [("card", "4111111111111111", 60)]
    assert found("visa 4111111111111111 y") == [("card", "4111111111111111", 85)]
    assert found("order 4111111111111111 y") == [("card", "4111111111111111", 35)]
    assert found("123-45-6789") == []
    assert found("social security 123-45-6789") == [("ssn", "123-45-6789", 65)]
    assert found("no " + "z" * 60 + " 030 555-1234") == []
    assert found("call 030 555-1234") == [("national", "030 555-1234", 55)]


def test_a_card_in_a_chain_of_numbers_needs_its_context():
    chain = "7536784127813051 4111111111111111"
    assert found(chain) == []
    assert found("credit card " + chain) == [("pan", "4111111111111111", 65)]


def test_added_spans_overlap_no_base_span():
    assert [kind for kind, *_ in found("phone +1 (030) 555-1234")] == ["phone"]


def test_long_texts_take_linear_time():
    for text in ("a" * 500_000, "1" * 500_000, "1.2.3." * 100_000, "+" * 200_000, "@" * 200_000, "AA11" * 100_000, "a.b@" * 100_000):
        personal_data.find_spans(text)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "write to a@b.cd or +1 (030) 555-1234 now"), (2, None), (3, "")], "doc_id INT, text STRING")
    assert [r["text"] for r in personal_data.redact(docs).orderBy("doc_id").collect()] == ["write to <email> or <phone> now", None, ""]


def test_clashing_names_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.cd x", "s", [1])], "doc_id INT, text STRING, spans STRING, periodic ARRAY<INT>")
    assert personal_data.scan_personal(docs).select("spans.start").first()[0] == [0]
    assert personal_data.scan_personal(docs).first()["periodic"] == [1]
    assert periodic_runs.find_runs(docs).first()["spans"] == "s"
    assert periodic_runs.find_runs(docs).first()["periodic"]["collapsed"] == "a@b.cd x"


def brute_lyndon(codes):
    out = []
    for i in range(len(codes)):
        j = i + 1
        while j < len(codes) and codes[j:] >= codes[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(codes, least, periods):
    shortest = {}
    for q in range(1, len(codes) // periods + 1):
        i = 0
        while i + q < len(codes):
            start = i
            while i + q < len(codes) and codes[i] == codes[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, periods * q):
                shortest.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((start, length, q) for (start, length), q in shortest.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng, size, kinds):
    words = [rng.randrange(kinds) for _ in range(size)]
    for _ in range(rng.randint(0, 3)):
        if size > 3:
            a = rng.randrange(size)
            end = rng.randint(a + 1, size)
            period = rng.randint(1, max(1, (end - a) // 3))
            for i in range(a, end):
                words[i] = words[a + (i - a) % period]
    return words


def test_lyndon_arrays_and_runs_match_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        words = periodic_words(rng, rng.randint(1, 60), rng.randint(1, 4))
        codes = np.array(words)
        assert periodic_runs.lyndon_lengths(codes).tolist() == brute_lyndon(words)
        for least, periods in ((2, 2), (6, 3), (24, 3)):
            assert [tuple(r) for r in periodic_runs.runs_of(codes, least, periods).tolist()] == brute_runs(words, least, periods)


def test_runs_of_structured_words():
    fibonacci, other = [0], [0, 1]
    while len(other) < 400:
        fibonacci, other = other, other + fibonacci
    thue = [bin(i).count("1") % 2 for i in range(256)]
    for words in (other, thue, [0] * 300, [0, 1] * 150, ([0] * 30 + [1]) * 8, list(range(50)) * 4):
        for least, periods in ((2, 2), (24, 3)):
            expected = brute_runs(words, least, periods)
            assert [tuple(r) for r in periodic_runs.runs_of(np.array(words), least, periods).tolist()] == expected


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words, 24, 3)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(word for i, word in enumerate(words) if i not in dropped)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(11)
    texts = [" ".join(f"w{c}é" for c in periodic_words(rng, rng.randint(0, 160), rng.choice([2, 5, 60]))) for _ in range(150)]
    rows = list(enumerate(texts)) + [
        (None, texts[3]), (7, texts[7]), (7, texts[7]), (900, None), (901, ""), (902, " \t\x0b\n"), (903, "one"),
        (904, "  a\tb\n " * 40), (905, "x y " * 30), (906, " ".join(str(i % 997) for i in range(6000))),
    ]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(repr(brute_row(*row)) for row in rows)


def test_planting_reads_the_original_words(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40))) for i in ids], "doc_id BIGINT, text STRING")
    for row in with_planted_periods(docs).collect():
        g = zlib.crc32(str(row["doc_id"]).encode()) // 10
        a = g % 40
        p = 1 + (40 - a) // (3 + g % 8)
        assert row["text"].split() == [f"w{k if k < a else a + (k - a) % p}" for k in range(40)]


def test_prefix_levels_keep_what_counting_keeps(spark):
    rng = random.Random(3)
    stems = ["ab", "abcd", "abcde", "abcdefgh", "abcdefghi", "x" * 40, "x" * 41, "é" * 9, "日本語のことば"]
    rows = [
        (rng.choice(["en", "de"]), " ".join(rng.choice(stems) + rng.choice(["", "a", "é", "zzzz" * 5]) for _ in range(rng.randint(0, 8))))
        for _ in range(60)
    ]
    postings = source_divergence.postings_of(spark.createDataFrame(rows, "lang STRING, text STRING").withColumn("source", F.lit("s")))
    expected = {}
    for lang, text in rows:
        for term in set(text.split()):
            expected[lang, term] = expected.get((lang, term), 0) + 1
    for least in (1, 3, 6):
        kept = source_divergence.kept_terms(postings, least, first=2)
        kept = kept.select("lang", F.col("term").cast("string")).collect()
        assert sorted(map(tuple, kept)) == sorted(key for key, n in expected.items() if n >= least)


@pytest.mark.parametrize("combined_bytes", [1, 1 << 25])
def test_postings_of_a_task_are_combined(spark, monkeypatch, combined_bytes):
    monkeypatch.setattr(source_divergence, "BATCH_BYTES", 8)
    monkeypatch.setattr(source_divergence, "COMBINED_BYTES", combined_bytes)
    data = [("en", "s", "to be or not to be")] * 3 + [("en", "t", "be or not"), ("de", "s", None), ("de", "s", "1 2"), ("en", "s", "to bed")]
    docs = spark.createDataFrame(data * 2, "lang STRING, source STRING, text STRING").coalesce(1)
    postings = source_divergence.postings_of(docs).collect()
    got = {}
    for r in postings:
        n, documents = got.get((r.lang, r.source, r.term and bytes(r.term), r.shared), (0, 0))
        got[r.lang, r.source, r.term and bytes(r.term), r.shared] = n + r.n, documents + r.documents
    want = {
        ("en", "s", b"be", -1): (12, 6), ("en", "s", b"not", 0): (6, 6), ("en", "s", b"or", 0): (6, 6), ("en", "s", b"to", 0): (14, 8),
        ("en", "s", b"bed", -1): (2, 2), ("en", "t", b"be", -1): (2, 2), ("en", "t", b"not", 0): (2, 2), ("en", "t", b"or", 0): (2, 2),
        ("de", "s", None, -1): (0, 4),
    }
    assert got == want
    assert len(postings) == len(want) or combined_bytes == 1


def test_pairs_in_tiles_match_one_tile(spark, folder, monkeypatch):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn(
        "source", F.concat("source", (F.col("doc_id") % 7).cast("string"))
    )
    whole = sorted(map(tuple, source_divergence.audit(docs, least=1).collect()), key=repr)
    monkeypatch.setattr(source_divergence, "TILE", 2)
    monkeypatch.setattr(source_divergence, "BLOCK_ROWS", 100)
    monkeypatch.setattr(source_divergence, "STEP", 16)
    assert sorted(map(tuple, source_divergence.audit(docs, least=1).collect()), key=repr) == whole
