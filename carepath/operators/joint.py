"""Logistic regressions of many labels, folds and penalties, fitted together.

All models of a search look at the same rows, so one pass over the rows gives the losses and gradients of all: a block of rows times
the matrix of all coefficients is one product. The driver takes one step of a quasi-Newton method for every model at once and sends
the new matrix. The passes over the data do not depend on the number of labels, folds or points. Each model has the objective of Spark's own
logistic regression: the weighted mean loss and a squared penalty on the coefficients of columns of deviation one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.constants import OUTCOME
from carepath.session import materialise

#: numbers of a block's products in a task, and partial sums that the driver adds up itself
CELLS = 1 << 21
PARTS = 32


@dataclass(frozen=True)
class Fit:
    """One model: its label, the fold it leaves out (none: -1), its penalty, and the weights of other rows and of cases."""

    label: int
    fold: int
    penalty: float
    weights: tuple[float, float] = (1.0, 1.0)


@dataclass
class JointModel:
    """Coefficients of one model for each class."""

    classes: list[str]
    coefficients: np.ndarray
    intercepts: np.ndarray

    def probabilities(self, features: Column) -> Column:
        """The probability of each class, in order, from a column of numbers."""
        return probabilities_of(self.coefficients, self.intercepts)(features)


def probabilities_of(coefficients: np.ndarray, intercepts: np.ndarray):
    """An Arrow function from features to the probabilities of all models."""

    def score(column: pa.Array) -> pa.Array:
        found = sigmoid(rows_of(column, coefficients.shape[1]) @ coefficients.T + intercepts)
        ends = np.arange(0, found.size + 1, max(len(intercepts), 1))
        return pa.ListArray.from_arrays(pa.array(ends[: len(column) + 1], pa.int32()), pa.array(found.reshape(-1)))

    return F.arrow_udf(score, "array<double>")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * np.clip(x, -1500, 1500)))


def rows_of(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def prepared(person: DataFrame, classes: list[str], fold: str | None = None) -> DataFrame:
    """``x, y, fold`` as plain arrays, written once: features, the presence of each class, and the fold (-1 without)."""
    present = F.array(*[F.coalesce(F.array_contains(OUTCOME, c), F.lit(False)).cast("double") for c in classes])
    number = F.lit(-1) if fold is None else F.col(fold)
    return materialise(person.select(vector_to_array("features").alias("x"), present.alias("y"), number.cast("int").alias("fold")), "joint")


def summed(rows: DataFrame, function: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int, labels: int) -> np.ndarray:
    """The sum over all blocks of rows of a flat array that ``function`` makes of features, labels and folds.

    A task adds up its own blocks; what the tasks have is added up in tasks too, if there are many.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            found = function(rows_of(batch.column(0), size), rows_of(batch.column(1), labels), batch.column(2).to_numpy(zero_copy_only=False))
            total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_py()) for batch in batches for x in batch.column(0)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], names=["sums"])

    sums = rows.mapInArrow(partial, "sums binary")
    parts = len(rows.inputFiles())
    if parts > PARTS:
        sums = sums.repartition(math.isqrt(parts)).mapInArrow(added, "sums binary")
    return np.sum([np.frombuffer(row["sums"]) for row in sums.collect()], axis=0)


def weights_in(fits: list[Fit], y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The weight of each row in each model; rows of the fold it leaves out have none."""
    other, case = (np.array([f.weights[k] for f in fits]) for k in (0, 1))
    return np.where(y > 0, case, other) * (fold[:, None] != np.array([f.fold for f in fits]))


def blockwise(block: int, x: np.ndarray, y: np.ndarray, fold: np.ndarray, function) -> np.ndarray:
    return np.sum([function(x[a : a + block], y[a : a + block], fold[a : a + block]) for a in range(0, max(len(x), 1), block)], axis=0)


def moments(rows: DataFrame, fits: list[Fit], size: int, labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of weights, means and deviations of the columns for each model, weighted as Spark's summarizer does."""
    which, block = [f.label for f in fits], max(1, CELLS // max(len(fits), size))

    def sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        w = weights_in(fits, y[:, which], fold)
        return np.concatenate([w.sum(0), (w**2).sum(0), (w.T @ x).ravel(), (w.T @ x**2).ravel()])

    found = summed(rows, lambda x, y, fold: blockwise(block, x, y, fold, sums), size, labels)
    k = len(fits)
    total, squares = found[:k], found[k : 2 * k]
    first, second = found[2 * k :].reshape(2, k, size)
    total = np.maximum(total, 1e-300)
    mean = first / total[:, None]
    spread = np.maximum(second - total[:, None] * mean**2, 0.0)
    spread[spread < 1e-12 * np.maximum(second, 1e-300)] = 0.0
    return total, mean, np.sqrt(spread / np.maximum(total - squares / total, 1e-300)[:, None])


def minimise(evaluate: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, most: int, tolerance: float = 1e-9) -> tuple[np.ndarray, int]:
    """Rows of ``start`` that each minimise their own function, and the number of evaluations.

    A limited-memory quasi-Newton method for all rows side by side; a row whose step does not lower its function halves it, and rows that
    have come to an end stand still.
    """
    x, passes = start, 1
    f, g = evaluate(x)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    still = np.zeros(len(x), bool)
    for _ in range(most):
        still |= np.abs(g).max(axis=1) <= tolerance * np.maximum(1.0, np.abs(f))
        if still.all():
            break
        d, kept = -g, []
        for s, y, rho in reversed(steps):
            a = rho * (s * d).sum(1)
            d = d - a[:, None] * y
            kept.append(a)
        if steps:
            s, y, rho = steps[-1]
            scale = np.where(rho > 0, (s * y).sum(1) / np.maximum((y * y).sum(1), 1e-300), 1.0)
            d = d * scale[:, None]
        for (s, y, rho), a in zip(steps, reversed(kept)):
            d = d + (a - rho * (y * d).sum(1))[:, None] * s
        slope = (g * d).sum(1)
        d = np.where((slope < 0)[:, None], d, -g)
        slope = np.minimum((g * d).sum(1), 0.0)
        t = np.ones(len(x)) if steps else 1.0 / np.maximum(1.0, np.sqrt((g * g).sum(1)))
        t[still] = 0.0
        for _ in range(25):
            tried = x + t[:, None] * d
            passes += 1
            f_new, g_new = evaluate(tried)
            worse = ~(f_new <= f + 1e-4 * t * slope + 1e-14 * np.abs(f)) & (t > 0)
            if not worse.any():
                break
            t = np.where(worse, t / 2, t)
        t = np.where(worse, 0.0, t)
        moved = (t > 0)[:, None]
        tried, g_new, f_new = np.where(moved, tried, x), np.where(moved, g_new, g), np.where(t > 0, f_new, f)
        s, y = tried - x, g_new - g
        curve = (s * y).sum(1)
        steps = [*steps[-9:], (s, y, np.where(curve > 1e-300, 1.0 / np.maximum(curve, 1e-300), 0.0))]
        still |= (t == 0) | (f - f_new <= tolerance * 1e-3 * np.maximum(np.abs(f), 1e-12))
        x, f, g = tried, f_new, g_new
    return x, passes


def fit_all(rows: DataFrame, fits: list[Fit], labels: int, most: int = 100) -> tuple[np.ndarray, np.ndarray, int]:
    """Coefficients (models × columns), intercepts and the number of passes over ``rows`` (of :func:`prepared`).

    A model whose rows are all of one class is a constant.
    """
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    size, k = int(first[0]), len(fits)
    total, mean, deviation = moments(rows, fits, size, labels)
    which, block = np.array([f.label for f in fits]), max(1, CELLS // k)
    penalty = np.array([f.penalty for f in fits])
    inverse = np.where(deviation > 0, 1.0 / np.where(deviation > 0, deviation, 1.0), 0.0)

    def counts(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        y = y[:, which]
        there = fold[:, None] != np.array([f.fold for f in fits])
        return np.concatenate([(there & (y > 0)).sum(0), (there & (y <= 0)).sum(0)]).astype(np.float64)

    cases, others = summed(rows, lambda x, y, fold: blockwise(block, x, y, fold, counts), size, labels).reshape(2, k)
    constant = (cases == 0) | (others == 0)

    def evaluate(scaled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        coefficients = scaled[:, :-1] * inverse
        intercepts = scaled[:, -1] - (coefficients * mean).sum(1)

        def sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
            y = y[:, which]
            w = weights_in(fits, y, fold)
            margin = x @ coefficients.T + intercepts
            loss = (w * (np.logaddexp(0.0, margin) - y * margin)).sum(0)
            wrong = w * (sigmoid(margin) - y)
            return np.concatenate([loss, wrong.sum(0), (wrong.T @ x).ravel()])

        found = summed(rows, lambda x, y, fold: blockwise(block, x, y, fold, sums), size, labels)
        loss, bias = found[:k] / total, found[k : 2 * k] / total
        slopes = found[2 * k :].reshape(k, size) / total[:, None]
        inner = scaled[:, :-1]
        gradient = (slopes - mean * bias[:, None]) * inverse + penalty[:, None] * inner
        value = loss + 0.5 * penalty * (inner**2).sum(1)
        return np.where(constant, 0.0, value), np.where(constant[:, None], 0.0, np.column_stack([gradient, bias]))

    start = np.zeros((k, size + 1))
    weighted = np.array([f.weights for f in fits])
    start[:, -1] = np.where(constant, 0.0, np.log(np.maximum(cases * weighted[:, 1], 1e-300) / np.maximum(others * weighted[:, 0], 1e-300)))
    scaled, passes = minimise(evaluate, start, most)
    coefficients = scaled[:, :-1] * inverse
    intercepts = scaled[:, -1] - (coefficients * mean).sum(1)
    never = np.where(cases == 0, -np.inf, np.inf)
    return np.where(constant[:, None], 0.0, coefficients), np.where(constant, never, intercepts), passes + 2
