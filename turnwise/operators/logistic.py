"""Logistic regressions of many cells at once: one job an iteration, whatever the number of fits.

A cell is a (layer, repeat): the rows of a layer that a repeat does not hold out. Each iteration is one
Arrow pass in which a task adds up the loss, gradient and Hessian of every cell it sees; the sums are
merged in two rounds and each cell's Newton step is solved where its sums are. Only steps come back to the
driver, one row a cell. Cells that have converged drop out of the passes that follow.

The objective is the sum of log losses plus ½·penalty·|w|² over all coefficients but the intercepts. Two
classes have one coefficient vector, more have one each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnwise.operators.gram import MERGE_PARTS

MAX_ITERATIONS = 60
#: A cell has converged when its next step would lower the loss by less than this.
TOLERANCE = 1e-10


def _probabilities(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def class_scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of all classes; with one vector the first class has none."""
    scores = x @ weights.T
    return np.hstack([np.zeros_like(scores), scores]) if weights.shape[0] == 1 else scores


def cell_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[n, loss, gradient …, Hessian …] of some rows; ``x`` starts with a column of ones."""
    scores = class_scores(x, weights)
    p = _probabilities(scores)
    top = scores.max(axis=1)
    loss = (top + np.log(np.exp(scores - top[:, None]).sum(axis=1)) - scores[np.arange(len(y)), y]).sum()
    first = p.shape[1] - weights.shape[0]
    p = p[:, first:]
    gap = p - (y[:, None] == np.arange(first, first + p.shape[1]))
    size = weights.size
    width = x.shape[1]
    hessian = np.empty((size, size))
    for c in range(p.shape[1]):
        for d in range(c, p.shape[1]):
            share = p[:, c] * ((c == d) - p[:, d])
            block = x.T @ (share[:, None] * x)
            hessian[c * width : (c + 1) * width, d * width : (d + 1) * width] = block
            hessian[d * width : (d + 1) * width, c * width : (c + 1) * width] = block
    return np.concatenate([[len(y), loss], (gap.T @ x).ravel(), hessian.ravel()])


def newton_step(sums: np.ndarray, weights: np.ndarray, penalty: float) -> tuple[float, float, np.ndarray]:
    """Loss with the penalty, what a step is about to lower it by, and the step."""
    size = weights.size
    held = np.ones_like(weights)
    held[:, 0] = 0
    held = penalty * held.ravel()
    flat = weights.ravel()
    gradient = sums[2 : 2 + size] + held * flat
    hessian = sums[2 + size :].reshape(size, size) + np.diag(held)
    # With a vector for each class the intercepts are free up to a constant; the shortest step leaves it.
    step = -np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0]
    return float(sums[1] + 0.5 * (held * flat * flat).sum()), float(-gradient @ step / 2), step


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Rows of one layer after another."""
    layers = batch.column(0).to_pylist()
    begin = 0
    for at in range(1, len(layers) + 1):
        if at == len(layers) or layers[at] != layers[begin]:
            yield layers[begin], batch.slice(begin, at - begin)
            begin = at


def _rows_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    features = _matrix(part.column("features"), part.num_rows)
    held = _matrix(part.column("held"), part.num_rows).astype(bool)
    return np.hstack([np.ones((part.num_rows, 1)), features]), held


@dataclass
class _Cell:
    """Where a cell's search stands: the last point that was taken, its loss, and the step from there."""

    weights: np.ndarray
    base: np.ndarray | None = None
    loss: float = np.inf
    step: np.ndarray | None = None
    scale: float = 1.0

    def advance(self, loss: float, gain: float, step: np.ndarray) -> bool:
        """Take the point and step on, or go half the way back; whether the cell has converged."""
        if loss > self.loss + 1e-9 * max(1.0, abs(self.loss)):
            self.scale /= 2
            self.weights = self.base + self.scale * self.step
            return self.scale < 1e-6
        self.base, self.loss, self.scale = self.weights, loss, 1.0
        self.step = step.reshape(self.weights.shape)
        self.weights = self.base + self.step
        return gain < TOLERANCE


def fit_cells(rows: DataFrame, classes: int, penalty: float = 1.0, iterations: int = MAX_ITERATIONS) -> dict[tuple, np.ndarray]:
    """Coefficients by (layer, repeat), the intercept first; one vector for two classes, else one a class.

    ``rows``: layer, ``y`` (class number), ``features`` (array of doubles, of one length a layer) and
    ``held`` (for each repeat, whether the row is held out), in order of layer within each partition.
    """
    spark = rows.sparkSession
    layer = rows.columns[0]
    vectors = 1 if classes <= 2 else classes
    cells: dict[tuple, _Cell] = {}
    done: set[tuple] = set()
    key = StructType([rows.schema[layer]]).add("repeat", "integer")
    for _ in range(iterations):
        known = spark.sparkContext.broadcast(({k: c.weights for k, c in cells.items()}, frozenset(done)))
        merged = _merged(rows, layer, _summing(known, vectors), key)
        steps = merged.mapInArrow(_solving(known, vectors, penalty), _schema(key, "loss double, gain double, step array<double>"))
        found = steps.collect()
        for row in found:
            at = (row[0], row["repeat"])
            step = np.array(row["step"])
            cell = cells.setdefault(at, _Cell(np.zeros((vectors, len(step) // vectors))))
            if cell.advance(row["loss"], row["gain"], step):
                done.add(at)
        known.destroy()
        if not found or len(done) == len(cells):
            break
    return {at: cell.weights for at, cell in cells.items()}


def _schema(key: StructType, more: str) -> StructType:
    return StructType([*key.fields, *StructType.fromDDL(more).fields])


def _summing(known, vectors: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, done = known.value
        sums: dict[tuple, np.ndarray] = {}
        kind = current = None

        def out() -> Iterator[pa.RecordBatch]:
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([at[0] for at in sums], kind), pa.array([at[1] for at in sums], pa.int32()),
                        pa.array([s for s in sums.values()], pa.list_(pa.float64())),
                    ],
                    ["layer", "repeat", "sums"],
                )
                sums.clear()

        for batch in batches:
            kind = batch.schema.field(0).type
            for layer, part in _runs(batch):
                if layer != current:
                    # Rows are in order of layer, so a task holds the sums of one layer's cells.
                    yield from out()
                    current = layer
                x, held = _rows_of(part)
                y = part.column("y").to_numpy()
                for repeat in range(held.shape[1]):
                    at = (layer, repeat)
                    if at in done:
                        continue
                    own = ~held[:, repeat]
                    start = weights.get(at)
                    start = np.zeros((vectors, x.shape[1])) if start is None else start
                    more = cell_sums(x[own], y[own], start)
                    sums[at] = sums[at] + more if at in sums else more
        yield from out()

    return summed


def _merged(rows: DataFrame, layer: str, summed, key: StructType) -> DataFrame:
    partial = rows.mapInArrow(summed, _schema(key, "sums array<double>"))
    partial = partial.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    added = Summarizer.sum(array_to_vector("sums")).alias("_sum")
    first = partial.groupBy(layer, "repeat", "_part").agg(added).withColumn("sums", vector_to_array("_sum"))
    return first.groupBy(layer, "repeat").agg(added).select(layer, "repeat", vector_to_array("_sum").alias("sums"))


def _solving(known, vectors: int, penalty: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, _ = known.value
        for batch in batches:
            found = []
            for layer, repeat, sums in zip(*(batch.column(i) for i in range(3))):
                sums = sums.values.to_numpy()
                start = weights.get((layer.as_py(), repeat.as_py()))
                if start is None:
                    size = int(((4 * len(sums) - 7) ** 0.5 - 1) / 2 + 0.5)
                    start = np.zeros((vectors, size // vectors))
                found.append(newton_step(sums, start, penalty))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.float64())),
                ],
                [*batch.schema.names[:2], "loss", "gain", "step"],
            )

    return solved


def predict_cells(rows: DataFrame, fits: dict[tuple, np.ndarray], carried: list[str]) -> DataFrame:
    """(layer, ``repeat``, carried columns, ``predicted``: class number) of all held-out rows."""
    known = rows.sparkSession.sparkContext.broadcast(fits)
    layer = rows.columns[0]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = known.value
        for batch in batches:
            for value, part in _runs(batch):
                x, held = _rows_of(part)
                for repeat in range(held.shape[1]):
                    at = np.flatnonzero(held[:, repeat])
                    weights = fits.get((value, repeat))
                    if weights is None or not len(at):
                        continue
                    chosen = part.take(pa.array(at))
                    best = class_scores(x[at], weights).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            chosen.column(layer), pa.array(np.full(len(at), repeat, np.int32)),
                            *(chosen.column(name) for name in carried), pa.array(best.astype(np.int32)),
                        ],
                        [layer, "repeat", *carried, "predicted"],
                    )

    schema = StructType([rows.schema[layer]]).add("repeat", "integer")
    schema = StructType([*schema.fields, *(rows.schema[name] for name in carried)]).add("predicted", "integer")
    return rows.mapInArrow(predicted, schema)
