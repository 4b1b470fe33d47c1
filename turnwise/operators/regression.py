"""Least squares, elastic net and variance inflation from moment matrices.

The solvers work on p×p matrices, one small row per fit; Spark spreads the fits of a grid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.config import ALPHA_RATIO, L1_RATIOS, MAX_ITER, N_ALPHAS, VIF_THRESHOLD
from turnwise.functions.structs import numeric_columns
from turnwise.functions.numeric import clean
from turnwise.operators.aggregates import null_safe_join
from turnwise.operators.gram import contiguous_matrix, gram, merge
from turnwise.session import cut_lineage

# Paths of a grid run side by side; a fixed number keeps them from being coalesced into one task.
PATH_TASKS = 64


def standardise(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Numeric columns to mean 0 and population deviation 1; a constant column becomes 0.

    The statistics are one row (per analysis), joined back by key.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    columns = [c for c in columns if c not in by]
    stats = df.groupBy(*by).agg(
        *[F.avg(clean(F.col(c).cast("double"))).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(clean(F.col(c).cast("double"))).alias(f"_s_{c}") for c in columns],
    )
    if by:
        center = {c: F.col(f"_m_{c}") for c in columns}
        scale = {c: F.col(f"_s_{c}") for c in columns}
        source = null_safe_join(df, stats, list(by))
    else:
        row = stats.first()
        center = {c: F.lit(row[f"_m_{c}"]) for c in columns}
        scale = {c: F.lit(row[f"_s_{c}"]) for c in columns}
        source = df
    scaled = {
        c: (F.col(c) - center[c]) / F.when(scale[c] == 0, F.lit(1.0)).otherwise(scale[c])
        for c in columns
    }
    return source.withColumns(scaled).select(*df.columns)


def _centred(moments: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """n, the means of [x, y], and their centred second moments divided by n."""
    n = moments[0, 0]
    mean = moments[0, 1:] / n
    return n, mean, moments[1:, 1:] / n - np.outer(mean, mean)


def _solve(second: np.ndarray) -> np.ndarray:
    """Minimum-norm least squares coefficients."""
    return np.linalg.pinv(second[:-1, :-1], rcond=1e-10, hermitian=True) @ second[:-1, -1]


def _r2(second: np.ndarray, coefficients: np.ndarray) -> float:
    total = second[-1, -1]
    residual = total - 2 * coefficients @ second[:-1, -1] + coefficients @ second[:-1, :-1] @ coefficients
    return float(1 - residual / total) if total > 0 else 0.0


_FIT_FIELDS = [
    T.StructField("feature", T.StringType()),
    T.StructField("coefficient", T.DoubleType()),
    T.StructField("intercept", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("n", T.LongType()),
]


def _schema(df: DataFrame, keys: Sequence[str], fields: list[T.StructField]) -> T.StructType:
    return T.StructType([df.schema[k] for k in keys] + fields)


def _fit_rows(key: list, names: Sequence[str], moments: np.ndarray, coefficients: np.ndarray) -> list[list]:
    n, mean, second = _centred(moments)
    intercept = float(mean[-1] - mean[:-1] @ coefficients)
    score = _r2(second, coefficients)
    return [
        [*key, name, float(c), intercept, score, int(n)] for name, c in zip(names, coefficients)
    ]


def ols_from_gram(moments: DataFrame, xs: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, feature, coefficient, intercept, r2, n) of least squares with an intercept."""
    keys, xs = list(keys), list(xs)
    schema = _schema(moments, keys, _FIT_FIELDS)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                matrix = contiguous_matrix(row["moments"])
                coefficients = _solve(_centred(matrix)[2])
                rows += _fit_rows([row[k] for k in keys], xs, matrix, coefficients)
            yield pd.DataFrame(rows, columns=schema.names)

    return moments.mapInPandas(fit, schema)


def ols(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return ols_from_gram(gram(df, xs, y, by), xs, by)


def descend(
    second: np.ndarray, alpha: float, l1_ratio: float, start: np.ndarray,
    max_iter: int = MAX_ITER, tolerance: float = 1e-10,
) -> np.ndarray:
    """Coordinate descent for ½w'Cw − q'w + α·l1·|w| + ½α(1−l1)·w'w.

    Sweeps run over the non-zero coordinates; a sweep over all of them ends the search or brings
    in new ones.
    """
    c, q = second[:-1, :-1], second[:-1, -1]
    w = start.copy()
    gradient = q - c @ w
    penalty, ridge = alpha * l1_ratio, alpha * (1 - l1_ratio)
    diagonal = np.diag(c)
    usable = np.flatnonzero(diagonal > 1e-14)
    limit = tolerance * max(np.sqrt(second[-1, -1]), 1e-300)
    everything = True
    for _ in range(max_iter):
        moved = 0.0
        for j in usable if everything else np.flatnonzero(w):
            pull = gradient[j] + diagonal[j] * w[j]
            size = abs(pull) - penalty
            new = np.copysign(size, pull) / (diagonal[j] + ridge) if size > 0 else 0.0
            change = new - w[j]
            if change:
                gradient -= c[:, j] * change
                w[j] = new
                moved = max(moved, abs(change) * np.sqrt(diagonal[j]))
        if moved <= limit:
            if everything:
                break
            everything = True
        else:
            everything = False
    return w


def alpha_path(second: np.ndarray, l1_ratio: float, n_alphas: int, ratio: float) -> np.ndarray:
    """Descending penalties from the smallest one that zeroes every coefficient."""
    top = np.abs(second[:-1, -1]).max() / l1_ratio
    if top <= 0:
        return np.full(n_alphas, np.finfo(float).resolution)
    return np.geomspace(top, top * ratio, n_alphas)


def _fold_error(moments: np.ndarray, mean: np.ndarray, w: np.ndarray) -> float:
    """Mean squared error on the rows behind a moment matrix."""
    residual = np.concatenate([[-(mean[-1] - mean[:-1] @ w)], -w, [1.0]])
    return float(residual @ moments @ residual / moments[0, 0])


def elastic_net_grid(
    moments: DataFrame, fold: str, by: Sequence[str] = (), l1_ratios: Sequence[float] = L1_RATIOS,
    n_alphas: int = N_ALPHAS, alpha_ratio: float = ALPHA_RATIO, max_iter: int = MAX_ITER,
) -> DataFrame:
    """(by, l1_ratio, alpha_index, alpha, fold, mse): the error of every penalty on every fold.

    Training moments are the total less the fold. Each (l1_ratio, fold) is one warm-started path
    and one row, so the paths run side by side.
    """
    by = list(by)
    packed = moments.groupBy(*by).agg(
        Summarizer.sum(array_to_vector("moments")).alias("_sum"),
        F.collect_list(F.struct(fold, "moments")).alias("_folds"),
    )
    paths = (
        packed.select(*by, vector_to_array("_sum").alias("_total"), F.inline("_folds"))
        .withColumn("l1_ratio", F.explode(F.array(*[F.lit(float(r)) for r in l1_ratios])))
        .repartition(PATH_TASKS, *by, fold, "l1_ratio")
    )
    schema = _schema(
        moments.withColumn("l1_ratio", F.lit(0.0)),
        [*by, fold, "l1_ratio"],
        [
            T.StructField("alpha_index", T.IntegerType()),
            T.StructField("alpha", T.DoubleType()),
            T.StructField("mse", T.DoubleType()),
        ],
    )

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                held, total = contiguous_matrix(row["moments"]), contiguous_matrix(row["_total"])
                alphas = alpha_path(_centred(total)[2], row["l1_ratio"], n_alphas, alpha_ratio)
                _, mean, second = _centred(total - held)
                w = np.zeros(len(second) - 1)
                for i, alpha in enumerate(alphas):
                    w = descend(second, alpha, row["l1_ratio"], w, max_iter)
                    rows.append(
                        [*[row[k] for k in by], row[fold], row["l1_ratio"], i, float(alpha),
                         _fold_error(held, mean, w)]
                    )
            yield pd.DataFrame(rows, columns=schema.names)

    return paths.select(*by, fold, "l1_ratio", "moments", "_total").mapInPandas(walk, schema)


def best_penalty(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The penalty with the least mean error; ties go to the smaller l1 ratio and larger alpha."""
    mean = grid.groupBy(*by, "l1_ratio", "alpha_index", "alpha").agg(F.avg("mse").alias("mse"))
    best = F.min(F.struct("mse", "l1_ratio", "alpha_index", "alpha"))
    return mean.groupBy(*by).agg(best.alias("_best")).select(
        *by,
        F.col("_best.alpha").alias("alpha"),
        F.col("_best.l1_ratio").alias("l1_ratio"),
        F.col("_best.mse").alias("mse"),
    )


def elastic_net_fit(
    moments: DataFrame, penalties: DataFrame, xs: Sequence[str], by: Sequence[str] = (),
    without: Sequence[str] = (), max_iter: int = MAX_ITER,
) -> DataFrame:
    """Fit at a given (alpha, l1_ratio) per analysis, on the features not in ``without``: a
    sub-matrix of the same moments."""
    by, xs = list(by), list(xs)
    kept = [i for i, x in enumerate(xs) if x not in set(without)]
    names = [xs[i] for i in kept]
    at = [0, *[i + 1 for i in kept], len(xs) + 1]
    small = penalties.select(*by, "alpha", "l1_ratio")
    # Both sides hold one row per analysis.
    joined = null_safe_join(moments, small, by)
    schema = _schema(joined, [*by, "alpha", "l1_ratio"], _FIT_FIELDS)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                matrix = contiguous_matrix(row["moments"])[np.ix_(at, at)]
                w = descend(
                    _centred(matrix)[2], row["alpha"], row["l1_ratio"], np.zeros(len(names)), max_iter
                )
                key = [*[row[k] for k in by], row["alpha"], row["l1_ratio"]]
                rows += _fit_rows(key, names, matrix, w)
            yield pd.DataFrame(rows, columns=schema.names)

    return joined.mapInPandas(fit, schema)


def elastic_net_cv(
    df: DataFrame, y: str, xs: Sequence[str], fold: str, by: Sequence[str] = (), **grid_options
) -> DataFrame:
    """Coefficients at the cross-validated penalty. The data are scanned once."""
    return elastic_net_cv_from_gram(gram(df, xs, y, [*by, fold]), xs, fold, by, **grid_options)


def elastic_net_cv_from_gram(
    moments: DataFrame, xs: Sequence[str], fold: str, by: Sequence[str] = (), **grid_options
) -> DataFrame:
    """The same from the moment matrices of the folds."""
    by, moments = list(by), cut_lineage(moments)
    penalties = best_penalty(elastic_net_grid(moments, fold, by, **grid_options), by)
    return elastic_net_fit(merge(moments, by), penalties, xs, by)


def inflation(moments: np.ndarray, intercept: bool) -> np.ndarray:
    """Variance inflation factors of the columns of a moment matrix."""
    return _factors(_correlations(moments, intercept))[0]


def _correlations(moments: np.ndarray, intercept: bool) -> np.ndarray:
    """Products of the columns with each other, scaled to ones on the diagonal; without an intercept they
    are not centred. A column without spread has zeros."""
    cross = _centred(moments)[2][:-1, :-1] if intercept else moments[1:-1, 1:-1] / moments[0, 0]
    size = np.sqrt(np.diag(cross))
    return cross / np.outer(np.where(size > 0, size, 1), np.where(size > 0, size, 1))


def _factors(scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The factors, and the inverse that has them on its diagonal unless the matrix is singular."""
    values, vectors = np.linalg.eigh(scaled)
    if not len(values):
        return np.zeros(0), None
    if values[0] > 1e-12 * values[-1]:
        inverse = (vectors / values) @ vectors.T
        return np.diag(inverse), inverse
    # Singular: the columns in the null space are exact combinations of others.
    null = values <= 1e-12 * max(values[-1], 0)
    tied = (vectors[:, null] ** 2).sum(axis=1) > 1e-9
    finite = (vectors[:, ~null] ** 2 / values[~null]).sum(axis=1)
    return np.where(tied, np.inf, finite), None


#: Above this factor a column is so close to others that taking it out of the inverse would cost digits.
SWEPT = 1e4


def _removals(scaled: np.ndarray, threshold: float) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
    """The columns that go, in their order, and those that stay, each with its factor.

    Taking a column out of the inverse is one sweep of the matrix, O(p²). A new inverse is formed only
    behind a column beyond ``SWEPT``, and for the factors of the columns that stay.
    """
    left, gone = list(range(len(scaled))), []
    factors, inverse = _factors(scaled)
    fresh = True
    while left:
        worst = int(factors.argmax())
        if not factors[worst] > threshold:
            if fresh:
                break
            # The sweeps' rounding decides nothing: the factors are formed anew before the search ends.
            factors, inverse = _factors(scaled[np.ix_(left, left)])
            fresh = True
            continue
        gone.append((left.pop(worst), float(factors[worst])))
        if inverse is None or factors[worst] > SWEPT:
            factors, inverse = _factors(scaled[np.ix_(left, left)])
            fresh = True
        else:
            column = np.delete(inverse[:, worst], worst)
            rest = np.delete(np.delete(inverse, worst, 0), worst, 1)
            inverse = rest - np.outer(column, column) / inverse[worst, worst]
            factors, fresh = np.diag(inverse), False
    return gone, list(zip(left, map(float, factors)))


def vif_step(
    df: DataFrame, xs: Sequence[str], threshold: float = VIF_THRESHOLD, intercept: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Stepwise removal of the column with the largest factor until none exceeds the threshold.

    (by, feature, step, vif): ``step`` counts removals, null for a kept column with its final
    factor. One scan; the steps work on the matrix and its inverse.
    """
    by, xs = list(by), list(xs)
    moments = gram(df.withColumn("_y", F.lit(0.0)), xs, "_y", by)
    schema = _schema(
        moments,
        by,
        [
            T.StructField("feature", T.StringType()),
            T.StructField("step", T.IntegerType()),
            T.StructField("vif", T.DoubleType()),
        ],
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for _, row in pdf.iterrows():
                key = [row[k] for k in by]
                gone, kept = _removals(_correlations(contiguous_matrix(row["moments"]), intercept), threshold)
                rows += [[*key, xs[at], step, factor] for step, (at, factor) in enumerate(gone, 1)]
                rows += [[*key, xs[at], None, factor] for at, factor in kept]
            out = pd.DataFrame(rows, columns=schema.names)
            out["step"] = out["step"].astype("Int32")
            yield out

    return moments.mapInPandas(search, schema)
