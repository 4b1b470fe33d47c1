from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise.llm import product_quantisation, url_cascade
from turnwise.llm.budget_mix import allocate, mix
from turnwise.llm.catalog import QUERIES
from turnwise.llm.components import components
from turnwise.llm.product_quantisation import similar_vectors
from turnwise.llm.toxicity import LEAST_Z, SeverityModel, fit_cumulative_link, fit_on_labels, score_severity, text_features
from turnwise.llm.url_cascade import build_cascade, judge_urls

from .conftest import texts_of

VECTORS = "vec_id BIGINT, label INT, embedding ARRAY<DOUBLE>, class STRING, n INT"


def brute_vectors(rows, cosine):
    good = [
        (i, label, np.array(v, float)) for i, label, v in rows
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links = {i: set() for i, _, _ in rows}
    for i, label, v in good:
        for j, other, w in good:
            if i != j and label == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                links[i].add(j)
    least = {}
    for i in links:
        seen, left = {i}, [i]
        while left:
            left += [j for j in links[left.pop()] if j not in seen and not seen.add(j)]
        least[i] = min(seen)
    return sorted((i, len(links[i]), least[i], least[i] == i) for i in links)


@pytest.mark.parametrize("tile", [1024, 16])
def test_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(product_quantisation, "TILE", tile)
    rng = np.random.default_rng(0)
    rows = []
    for group in range(6):
        centre = rng.normal(size=16)
        for _ in range(25):
            rows.append((len(rows), group % 2, (centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.1, 0.3])).tolist()))
    rows += [(200 + i, i % 2, rng.normal(size=16).tolist()) for i in range(100)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-200] * 16, [1.0] * 16]
    rows += [(400 + i, 0, v) for i, v in enumerate(odd)] + [(450, None, [1.0] * 16), (451, 1, [1.0] * 16)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)
    got = sorted(tuple(r) for r in similar_vectors(df, 0.98).collect())
    assert got == brute_vectors([(i, label, v) for i, label, v in rows if i != 408] + [(408, 0, [1.0] * 16)], 0.98)
    assert similar_vectors(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 60)] + [(7, 7), (500, 500)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 0 for i in range(60)}, 500: 500}


URLS = [
    None, "no scheme", "http://A.Example.ORG/es/x?y", "https://example.org", "http://example.org/en/12#z", "http://x.com/fr/",
    "http://x.com/de/1", "http://notexample.org/es/", "http://plain.net/a", "https://safe.net/a", "http://plain.net?q", "http://",
]


@pytest.mark.parametrize("bits", [url_cascade.MAX_BITS, 0])
def test_urls(spark, bits):
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(URLS)], "page_id BIGINT, url STRING, host STRING")
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/"), ("allow", "com", "/fr/")]
    keys = spark.createDataFrame([("plain.net", True), ("safe.net", False), ("", True), (None, True), ("plain.net", None)], "host STRING, listed BOOLEAN")
    rows = judge_urls(pages, rules, build_cascade(keys, "host", "listed", bits)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.org", "/es/x", "example.org/es/", "block"),
        ("example.org", "", None, "allow"), ("example.org", "/en/12", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"),
        ("x.com", "/de/1", "com/de/", "block"), ("notexample.org", "/es/", "org/", "allow"), ("plain.net", "/a", None, "block"),
        ("safe.net", "/a", None, "allow"), ("plain.net", "", None, "block"), ("", "", None, "allow"),
    ]
    assert judge_urls(pages.limit(0), rules, build_cascade(keys.limit(0), "host", "listed", bits)).count() == 0


def test_cascade_has_no_mistakes(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = build_cascade(keys, "key", "listed")
    assert len(cascade.levels) > 1
    assert cascade.mark(keys, F.col("key"), "in").filter(F.col("in") != F.col("listed")).count() == 0


LEVELS = ["domain", "lang"]


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)], "domain STRING, lang STRING, capacity BIGINT")
    even = {level: F.lit(1) for level in LEVELS}
    got = {(r.domain, r.lang): int(r.tokens) for r in allocate(leaves, LEVELS, even, F.lit(400)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    got = {(r.domain, r.lang): int(r.tokens) for r in allocate(leaves, LEVELS, even, F.lit(3000)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 990 + 10, ("b", "x"): 995, ("b", "y"): 995}
    none = {"domain": F.when(F.col("domain") == "a", 1), "lang": F.lit(1)}
    got = {(r.domain, r.lang): int(r.tokens) for r in allocate(leaves, LEVELS, none, F.lit(400)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 390, ("b", "x"): 0, ("b", "y"): 0}


def test_weights_of_zero_below_the_top_are_no_capacity(spark):
    leaves = spark.createDataFrame([("a", "x", 1000), ("a", "y", 10), ("b", "x", 1000)], "domain STRING, lang STRING, capacity BIGINT")
    path = F.concat("domain", "lang")
    for zero in (F.when(path == "ax", 0).otherwise(1), F.when(path != "ax", 1), F.when(path == "ax", -2).otherwise(1)):
        rows = allocate(leaves, LEVELS, {"domain": F.lit(1), "lang": zero}, F.lit(400)).collect()
        assert {(r.domain, r.lang): int(r.tokens) for r in rows} == {("a", "x"): 0, ("a", "y"): 10, ("b", "x"): 390}


def test_mix_takes_epochs_and_a_prefix(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(i, "a b c", "en" if i % 4 else "de", None) for i in range(400)], "doc_id BIGINT, text STRING, lang STRING, domain STRING")
    weights = {"domain": F.lit(1), "lang": F.lit(1)}
    rows = mix(docs, LEVELS, weights, share=(1, 2), epochs=3).collect()  # 600 tokens, 300 for each language
    german = [r for r in rows if r.lang == "de"]
    assert sum(r._taken for r in german) == 300 and {r._epoch for r in german} == {0} and len(german) == 100
    rows = mix(docs, LEVELS, weights, share=(1, 1), epochs=2).collect()  # 1200: 600 and 600, in two epochs of 300
    german = [r for r in rows if r.lang == "de"]
    assert sum(r._taken for r in german) == 600 and {r._epoch for r in german} == {0, 1}
    assert sum(r._taken for r in rows) == 1200
    odd = mix(odd_docs.drop("n").withColumn("domain", F.lit("d")), LEVELS, weights, share=(1, 1))
    assert odd.count() == odd_docs.count()
    assert mix(no_docs.withColumn("domain", F.lit("d")), LEVELS, weights).count() == 0


def test_copies_are_judged_by_id_and_text(spark, no_docs):
    """A text whose id also has another text is dropped or kept for its own sake."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (6, b + " end"), (None, a), (None, "alone " * 3), (7, ""), (7, None), (8, "c d"), (8, "e f")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = texts_of(corpus_pipeline.near_duplicates(spark, docs, ""))
    assert sorted(got, key=repr) == sorted([(3, a), (5, b), (None, "alone " * 3), (7, ""), (7, None), *rows[8:]], key=repr)
    copies = spark.createDataFrame([(1, a), (1, a + " end"), (1, a), (2, a)], "doc_id BIGINT, text STRING")
    assert len(texts_of(corpus_pipeline.near_duplicates(spark, copies, ""))) == 1
    assert corpus_pipeline.near_duplicates(spark, no_docs, "").count() == 0


def test_thresholds_share_weights():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2))
    latent = x @ [2.0, -1.0] + rng.logistic(size=3000)
    grades = np.digitize(latent, [-1.0, 1.5])
    rows, columns = np.repeat(np.arange(3000), 2), np.tile([0, 1], 3000)
    w, cuts = fit_cumulative_link(rows, columns, x.ravel(), grades, np.ones(3000), 2, 3, 0.0, 800)
    assert np.allclose(w, [2, -1], atol=0.25) and np.allclose(cuts, [-1, 1.5], atol=0.25)


def test_severity(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    plain = [f"plain{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        words = rng.choice(plain, 30).tolist()
        toxic = i % 5 == 0
        if toxic:
            words[3 : 3 + 1 + i % 4] = rng.choice(["vileword", "awfulword"], 1 + i % 4).tolist()
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    known = spark.createDataFrame([*labels[:400], (None, 1), (5000, None)], "doc_id BIGINT, toxic INT")
    model = fit_on_labels(frame, known)
    got = {r.doc_id: r for r in score_severity(frame, model).collect()}
    assert all(got[i].toxic == bool(t) for i, t in labels)  # a third of them were not in the sample
    assert np.mean([got[i].severity for i in range(0, 600, 5) if i % 4 == 3]) > np.mean([got[i].severity for i in range(0, 600, 5) if i % 4 == 0])
    odd = score_severity(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(r.severity == 0 for r in odd if not r.text)
    assert score_severity(no_docs, model).count() == 0
    nothing = fit_on_labels(no_docs, known.limit(0))
    assert not any(r.toxic for r in score_severity(odd_docs, nothing).collect())


def test_texts_of_one_vocabulary_and_both_labels_are_no_copies(spark):
    """All share the words of least hash, and each toxic text has a clean one of smaller id beside it."""
    rng = np.random.default_rng(6)
    words = sorted((f"plain{i}" for i in range(400)), key=lambda w: zlib.crc32(w.encode()))
    docs = [(i, " ".join([*words[:5], *rng.choice(words[5:], 40), *(["vileword"] if i % 2 else [])])) for i in range(400)]
    docs += [(1000 + i, text) for i, text in docs[1:100:2]]
    labels = [(i, i % 2) for i in range(400)] + [(1000 + i, 0) for i, _ in docs[1:100:2]]
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    model = fit_on_labels(frame, spark.createDataFrame(labels, "doc_id BIGINT, toxic INT"))
    got = {r.doc_id: r.toxic for r in score_severity(frame, model).collect()}
    assert all(got[i] == bool(i % 2) for i in range(400))


def test_grades_of_the_labels_are_kept(spark):
    rng = np.random.default_rng(7)
    plain, vile = [f"plain{i}" for i in range(300)], [f"vile{i}" for i in range(8)]
    docs, labels = [], []
    for i in range(800):
        grade = (0, 1, 2, 4)[i % 4]
        docs.append((i, " ".join([*rng.choice(plain, 30), *rng.choice(vile, (0, 2, 4, 8)[i % 4], replace=False)])))
        labels.append((i, grade))
    frame = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    model = fit_on_labels(frame, spark.createDataFrame(labels, "doc_id BIGINT, toxic INT"))
    assert len(model.thresholds) == 4
    got = {r.doc_id: r.severity for r in score_severity(frame, model).collect()}
    means = [np.mean([got[i] for i in range(k, 800, 4)]) for k in range(4)]
    assert means == sorted(means) and means[0] < 0.5 and means[3] > 3


def test_severity_matches_brute_force(spark, odd_docs, tmp_path):
    """The kept features from plain counts, and the rows of the query from plain sums over sets of features."""
    rng = np.random.default_rng(9)
    plain, vile = [f"plain{i}" for i in range(120)], ["vileword", "Awful!", "(bad"]
    docs = [(i, " ".join([*rng.choice(plain, 30), *(rng.choice(vile, 2) if i % 4 == 0 else [])])) for i in range(500)]
    frame = spark.createDataFrame([(1000 + i, t) for i, t in docs], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(1000 + i, int(i % 4 == 0)) for i, _ in docs], "doc_id BIGINT, toxic INT")
    model = fit_on_labels(frame, labels)
    counts = [Counter(f for i, t in docs if (i % 4 == 0) == side for f in text_features(t)) for side in (False, True)]
    told = set()
    for feature in counts[0] | counts[1]:
        a, b = counts[1][feature] + 0.5, counts[0][feature] + 0.5
        c, d = 125 - a + 1, 375 - b + 1
        if abs(math.log(a / c) - math.log(b / d)) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d) >= LEAST_Z:
            told.add(feature)
    assert set(model.weights) == told and told

    odd = [(None, "vileword"), (9001, "\tvileword\nAWFUL\x0b\x0c(bad\r"), (9002, "vileword\u00a0awful"), (9003, "x " * 50_000 + "awful")]
    texts = frame.union(odd_docs.select("doc_id", "text")).union(spark.createDataFrame(odd, frame.schema))
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    want = []
    for i, text in texts_of(texts):
        score = sum(model.weights.get(f, 0.0) for f in text_features(text or ""))
        above = [1 / (1 + math.exp(cut - score)) if text else 0.0 for cut in model.thresholds]
        want.append((str(i), round(sum(above), 9), round(above[0], 9), above[0] >= 0.5))
    got = [(str(r.doc_id), round(r.severity, 9), round(r.p_toxic, 9), r.toxic) for r in QUERIES["op2_toxicity"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


CLASHING = ["toxic", "severity", "_score", "score", "domain", "Text", "_rest", "_hit", "_of", "_kept", "root", "_tokens", "_row", "_words", "n", "class"]


def test_operators_keep_columns_with_clashing_names(spark, odd_docs):
    plain = odd_docs.select("doc_id", "text", "lang")
    docs = plain.select("*", *(F.lit(k).alias(name) for k, name in enumerate(CLASHING)))
    scored = score_severity(docs, SeverityModel({"one": 2.0}, [0.5]))
    assert scored.columns == [*plain.columns, *CLASHING[2:], "severity", "p_toxic", "toxic"]
    assert {tuple(r)[3:17] for r in scored.collect()} == {tuple(range(2, 16))}
    mixed = mix(docs, ["domain", "lang"], {"domain": F.lit(1), "lang": F.lit(1)}, share=(1, 1))
    left = [c for c in CLASHING if c != "_tokens"]
    assert mixed.columns == [*plain.columns, *left, "_tokens", "_epoch", "_taken"]
    assert mixed.count() == docs.count() and mixed.select(*(c for c in left if c != "Text")).distinct().count() == 1


def test_ids_that_are_no_numbers_have_no_labels(spark):
    docs = spark.createDataFrame([("a", "some text"), ("2", "more")], "doc_id STRING, text STRING")
    labels = spark.createDataFrame([("a", 1), ("2", 0)], "doc_id STRING, toxic INT")
    assert not any(r.toxic for r in score_severity(docs, fit_on_labels(docs, labels)).collect())


FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline(spark, odd_docs, tmp_path):
    """Each stage against a plain version of itself on what the stage before it left."""
    from .test_llm_text_operators import brute_components

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "token_files":
            assert docs.columns == before.columns
        if name == "near_duplicates":
            want = {int(i) for i, _, c in brute_components(texts_of(before), 5, 80) if i == c}
            assert kept[name] == want
    clean = {r.doc_id for r in QUERIES["op2_toxicity"](spark, FOLDER).collect() if not r.toxic}
    assert kept["toxicity"] == clean
    assert kept["token_files"] == kept["mixing"] < kept["decontamination"] < kept["toxicity"]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    folder = str(tmp_path)
    odd_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 5


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages_keep_columns_with_clashing_names(spark, odd_docs, no_docs):
    """Extra columns leave each stage as they came, beside the rows that stay without them."""
    plain = odd_docs.select("doc_id", "text", "lang", "source")
    docs = plain.select("*", *(F.lit(k).alias(name) for k, name in enumerate(CLASHING)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns, name
        rows = [tuple(r) for r in got.collect()]
        assert rows and {r[4:] for r in rows} == {tuple(range(16))}, name
        want = [tuple(r) for r in stage(spark, plain, FOLDER).collect()]
        assert sorted((r[:2] for r in rows), key=repr) == sorted((r[:2] for r in want), key=repr), name
        empty = stage(spark, no_docs, FOLDER)
        assert empty.columns == no_docs.columns and empty.count() == 0
    assert corpus_pipeline.token_files(spark, docs.toDF(*plain.columns, *(c if c != "Text" else "t" for c in CLASHING)), FOLDER).count() == docs.count()


def test_clean_texts_without_an_id_stay(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(None, "a " + item), (None, "clean"), (None, None), (1, item), (1, "other text"), (2, "")], "doc_id BIGINT, text STRING")
    spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = texts_of(corpus_pipeline.decontamination(spark, docs, str(tmp_path)))
    assert sorted(got, key=repr) == sorted([(None, "clean"), (None, None), (1, "other text"), (2, "")], key=repr)
