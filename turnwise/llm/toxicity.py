"""Toxicity by cumulative-link ordinal regression.

The grades 0 < 1 < ... of a text share one weight for each sparse feature across all thresholds:
``P(grade > k) = 1 / (1 + exp(threshold[k] - score))``, and the expected severity is the sum of these
probabilities. Features are the words of a text and their first four and five letters, each counted; those are kept whose presence tells toxic from
clean documents in the sample.

The model is fitted on a bounded sample of labelled rows: ``PER_CLASS`` documents of each grade, the
first by a hash of their id, weighted to the grades' true shares. Scores cover every row and its whole
text; a worker sees each distinct word of a batch once.

Labels that are null or negative, ids that are no whole number and labelled documents without text are left
out of the sample, and a document with several labels has its highest. Null and empty texts have severity 0. Without both
kinds of labels every severity is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.llm.common import set_aside, stored

#: Most documents of each label in the sample.
PER_CLASS = 3000
MAX_FEATURES = 4096
#: Least absolute log odds ratio of a kept feature, in standard errors.
LEAST_Z = 4.0
PENALTY = 1e-5
STEPS = 400
#: Least word hashes by which copies in the sample are told.
SKETCH = 32
TRIMMED = " \t\r\n\x0b\x0c.,;:!?\"'()[]{}<>*#$%&@/\\|=+~^`_-…“”„«»¿¡"
SEPARATORS = " \n\t\r\x0b\x0c"


def word_features(word: str) -> list[str]:
    word = word.strip(TRIMMED).lower()
    if not word:
        return []
    return [word, *("^" + word[:n] for n in (4, 5) if len(word) >= n)]


def text_features(text: str) -> set[str]:
    return {name for word in set(re.findall(f"[^{SEPARATORS}]+", text)) for name in word_features(word)}


@dataclass
class SeverityModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return _logistic(np.asarray(scores)[:, None] - np.asarray(self.thresholds)[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, weights: np.ndarray,
    n_columns: int, n_grades: int, penalty: float = PENALTY, steps: int = STEPS,
) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds; the steps are Adam's on the whole penalised likelihood.

    Thresholds are a first value and the logarithms of the gaps, so they stay in order.
    """
    share = weights / weights.sum()
    reached = np.array([share[grades > k].sum() for k in range(n_grades - 1)])
    cuts = -np.log(np.clip(reached, 1e-6, 1 - 1e-6) / np.clip(1 - reached, 1e-6, 1))
    gaps = np.log(np.maximum(np.diff(cuts), 1e-3))
    point = np.concatenate([np.zeros(n_columns), cuts[:1], gaps])
    mean, square = np.zeros_like(point), np.zeros_like(point)
    padded = lambda t: np.concatenate([[-np.inf], t, [np.inf]])
    for step in range(1, steps + 1):
        w, first, gap = point[:n_columns], point[n_columns], np.exp(point[n_columns + 1 :])
        thresholds = first + np.concatenate([[0.0], np.cumsum(gap)])
        score = np.bincount(rows, values * w[columns], len(grades))
        bounds = padded(thresholds)
        high, low = _logistic(bounds[grades + 1] - score), _logistic(bounds[grades] - score)
        high[np.isposinf(bounds[grades + 1])], low[np.isneginf(bounds[grades])] = 1.0, 0.0
        chance = np.maximum(high - low, 1e-12)
        at_high, at_low = share * high * (1 - high) / chance, share * low * (1 - low) / chance
        slope = np.zeros_like(point)
        slope[:n_columns] = np.bincount(columns, values * (at_high - at_low)[rows], n_columns) + penalty * w
        by_cut = np.bincount(grades, at_low, n_grades)[1:] - np.bincount(grades, at_high, n_grades)[:-1]
        slope[n_columns] = by_cut.sum()
        slope[n_columns + 1 :] = np.cumsum(by_cut[::-1])[::-1][1:] * gap
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        rate = 0.1 * (1 - step / (steps + 1))
        point = point - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    gap = np.exp(point[n_columns + 1 :])
    return point[:n_columns], point[n_columns] + np.concatenate([[0.0], np.cumsum(gap)])


def _signature(text: str) -> str:
    """The SKETCH words of least hash. A passage copied many times has them in common, so that it need
    not count as that many texts that agree."""
    return " ".join(map(str, sorted(zlib.crc32(word.encode()) for word in set(text.split()))[:SKETCH]))


SAMPLED = "doc_id bigint, grade int, signature string, features array<string>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            piece = batch.slice(at, 200)
            texts = piece.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), piece.column("grade"), pa.array(map(_signature, texts), pa.string()),
                    pa.array([sorted(text_features(t)) for t in texts], pa.list_(pa.string())),
                ],
                names=["doc_id", "grade", "signature", "features"],
            )


def telling_features(sample: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, float]]:
    """At most MAX_FEATURES features and their log odds ratios in standard errors, the largest first."""
    counts = sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    c, d = n_toxic - F.col("a") + 0.5, n_clean - F.col("b") + 0.5
    z = (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    told = counts.select("feature", z.alias("z")).filter(F.abs("z") >= LEAST_Z)
    rows = told.orderBy(F.abs("z").desc(), "feature").limit(MAX_FEATURES).collect()
    return [(r["feature"], r["z"]) for r in rows]


def fit_on_labels(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> SeverityModel:
    """Draw the sample and fit. ``labels``: ``doc_id`` and ``toxic``, 0/1 or a grade.

    Without grades above 1, toxic documents are grade 1, or 2 where more features tell that they are toxic
    than in the median toxic document. Copies count once for each grade they have. The driver gets the chosen features of each document of the sample, no text.
    """
    known = labels.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "toxic")
    known = known.filter("doc_id IS NOT NULL AND toxic >= 0").groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("grade")
    )
    known = stored(known, "labels")
    totals = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if 0 not in totals or len(totals) < 2:
        return SeverityModel()
    parts = [
        known.filter(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        for grade in sorted(totals)
    ]
    sample = stored(reduce(DataFrame.unionByName, parts), "sample")
    texts = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "text").filter("text <> ''")
    texts = texts.join(sample, "doc_id").select("doc_id", "text", "grade")
    described = stored(texts.mapInArrow(_describe, SAMPLED), "described")
    first = described.groupBy("signature", "grade").agg(F.min("doc_id").alias("doc_id"))
    single = described.join(first, ["signature", "grade", "doc_id"]).dropDuplicates(["signature", "grade"])
    single = stored(single.withColumn("toxic", F.least("grade", F.lit(1))), "single")
    drawn = {r["grade"]: r["n"] for r in single.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if 0 not in drawn or len(drawn) < 2:
        return SeverityModel()
    kept = telling_features(single, sum(drawn.values()) - drawn[0], drawn[0])
    place = {name: i for i, (name, _) in enumerate(kept)}
    chosen = F.array_intersect("features", F.lit(list(place)) if place else F.array().cast("array<string>"))
    rows = single.orderBy("doc_id").select("grade", chosen.alias("features")).collect()  # the bounded sample
    levels, grades = np.unique([r["grade"] for r in rows], return_inverse=True)
    weights = np.array([totals[grade] / drawn[grade] for grade in levels.tolist()])[grades]
    columns = [np.array([place[f] for f in r["features"]], np.int64) for r in rows]
    if levels.tolist() == [0, 1]:
        tells = np.array([z > 0 for _, z in kept], bool)
        told = np.array([tells[c].sum() for c in columns])
        grades = grades + ((grades == 1) & (told > np.median(told[grades == 1])))
        levels = np.arange(grades.max() + 1)
    flat = np.concatenate(columns)
    w, thresholds = fit_cumulative_link(
        np.repeat(np.arange(len(rows)), [len(c) for c in columns]), flat, np.ones(len(flat)), grades, weights,
        len(kept), int(grades.max()) + 1,
    )
    # A grade that no document has lies as high as the next one.
    return SeverityModel(dict(zip(place, w.tolist())), np.repeat(thresholds, np.diff(levels)).tolist())


def score_texts(texts: pa.Array, weights: dict[str, float]) -> np.ndarray:
    """The linear score of each text."""
    spaced = pc.fill_null(texts, "")
    for separator in SEPARATORS[1:]:
        spaced = pc.replace_substring(spaced, pattern=separator, replacement=" ")
    pieces = pc.split_pattern(spaced, pattern=" ")
    words = pieces.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    known = {name: i for i, name in enumerate(weights)}
    of_word = [[known[f] for f in word_features(w) if f in known] for w in distinct]
    n_features = np.fromiter(map(len, of_word), np.int64, len(of_word))
    order, ends = words.indices.to_numpy(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    hit = n_features[order] > 0
    rows, order = rows[hit], order[hit]
    features = np.array([f for w in order.tolist() for f in of_word[w]], np.int64)
    present = np.unique(np.repeat(rows, n_features[order]) * max(1, len(known)) + features)
    values = np.fromiter(weights.values(), float, len(weights))
    return np.bincount(present // max(1, len(known)), values[present % max(1, len(known))], len(ends) - 1)


def score_severity(docs: DataFrame, model: SeverityModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``p_toxic`` (P(grade > 0)) and ``toxic``.

    Columns of ``docs`` with these names give way to them; all others stay as they are."""
    @F.pandas_udf("severity double, p_toxic double")
    def score(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 2))
        if model.thresholds:
            for at in range(0, len(texts), 1000):
                part = pa.array(texts.iloc[at : at + 1000], pa.string())
                above = model.above(score_texts(part, model.weights))
                above[pc.equal(pc.fill_null(pc.binary_length(part), 0), 0).to_numpy(zero_copy_only=False)] = 0
                out[at : at + 1000] = np.column_stack([above.sum(axis=1), above[:, 0]])
        return pd.DataFrame(out, columns=["severity", "p_toxic"])

    plain, restore = set_aside(docs, ["text"])
    scored = plain.withColumn("score", score("text")).select("*", "score.severity", "score.p_toxic")
    scored = scored.withColumn("toxic", F.col("p_toxic") >= threshold)
    return restore(scored, "severity", "p_toxic", "toxic")
