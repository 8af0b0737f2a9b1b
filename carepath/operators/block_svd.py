"""Largest singular values and right vectors of a sparse matrix in a few passes over its rows.

A pass multiplies AᵗA with a block of vectors: each task multiplies its rows with the whole block and sums what they add, so that one
pass does for all vectors what a power or Lanczos step does for one. The blocks of all passes together span a Krylov space, in which the
driver solves the small problem: as many rows and columns as there are vectors, whatever the rows of the matrix are. For a matrix
with no more columns than that the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: passes over the rows, and vectors of a block beyond the ones asked for
PASSES, MORE = 6, 60
#: numbers that a task holds of a sum (256 MB); with more columns a pass takes the block in slices
HELD = 1 << 25
#: numbers of the products of some rows, and columns whose sums travel together
CELLS, COLUMNS = 1 << 21, 1 << 12
#: of the largest value: changes that end the passes, and values that count as none
SETTLED, NONE = 1e-6, 1e-7


def added_products(indices: np.ndarray, values: np.ndarray, starts: np.ndarray, block: np.ndarray, total: np.ndarray) -> None:
    """Add AᵗA · block to ``total`` for some sparse rows, given by their entries and the first entry of each."""
    ends = np.append(starts[1:], len(indices))
    limit = max(1, CELLS // block.shape[1])
    row = 0
    while row < len(starts):
        # whole rows, one at least
        after = max(row + 1, int(np.searchsorted(ends, starts[row] + limit, side="right")))
        first, last = starts[row], ends[after - 1]
        columns, weights = indices[first:last], values[first:last, None]
        products = np.add.reduceat(block[columns] * weights, starts[row:after] - first, axis=0)
        order = np.argsort(columns, kind="stable")
        found, begins = np.unique(columns[order], return_index=True)
        owners = np.repeat(np.arange(after - row), ends[row:after] - starts[row:after])
        total[found] += np.add.reduceat((products[owners] * weights)[order], begins, axis=0)
        row = after


def gram_product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """AᵗA · block for a table ``indices, values`` of rows with an entry each at least. Sums meet by ranges of columns, in tasks."""
    size, width = block.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            total = np.zeros(block.shape) if total is None else total
            lists = batch.column(0)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            indices = lists.flatten().to_numpy(zero_copy_only=False)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            added_products(indices, values, np.cumsum(lengths, dtype=np.int64) - lengths, block, total)
        if total is not None:
            for first in range(0, size, COLUMNS):
                part = total[first : first + COLUMNS]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["first", "sums"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for first, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(part.as_buffer())
                sums[first] = sums[first] + found if first in sums else found
        for first, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([found.tobytes()], pa.binary())], names=["first", "sums"])

    schema = "first int, sums binary"
    sums = rows.select("indices", "values").mapInArrow(partial, schema)
    result = np.zeros(block.shape)
    for row in sums.repartition(math.ceil(size / COLUMNS), "first").mapInArrow(together, schema).collect():
        part = np.frombuffer(row["sums"]).reshape(-1, width)
        result[row["first"] : row["first"] + len(part)] = part
    return result


def orthonormal(block: np.ndarray, basis: np.ndarray | None, floor: float) -> np.ndarray:
    """Directions of ``block`` outside ``basis``; those shorter than ``floor`` are rounding."""
    for turn in range(2):  # the second turn takes out what rounding has left of the basis
        if basis is not None:
            block = block - basis @ (basis.T @ block)
        if block.shape[1]:
            left, lengths, _ = np.linalg.svd(block, full_matrices=False)
            block = left[:, lengths > (floor if turn == 0 else 0.5)]
    return block


def largest_singular(rows: DataFrame, size: int, d: int, passes: int = PASSES, more: int = MORE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``(values, vectors)``: the ``d`` largest singular values, fewer if the rank is less, and their right vectors as columns.

    ``rows`` has ``indices, values``, the entries of a row, and ``size`` is the number of columns. Passes end before ``passes`` when the
    values have settled or the space is exhausted. The driver holds ``passes * (d + more)`` numbers for each column. Equal on every run up
    to the order in which sums are added. A matrix without rows has no values.
    """
    if not size:
        return np.zeros(0), np.zeros((0, 0))
    width = min(d + more, size)
    start = np.random.default_rng(seed).standard_normal((size, width))
    block = orthonormal(start, None, 0.0)
    basis, small, before = np.zeros((size, 0)), np.zeros((0, 0)), np.zeros(0)
    for _ in range(passes):
        step = max(1, HELD // max(size, 1))
        product = np.hstack([gram_product(rows, np.ascontiguousarray(block[:, a : a + step])) for a in range(0, block.shape[1], step)])
        basis = np.hstack([basis, block])
        # projections on the vectors so far: the last columns, and by symmetry the last rows, of the small matrix
        last = basis.T @ product
        grown = np.zeros((basis.shape[1],) * 2)
        grown[: len(small), : len(small)] = small
        grown[:, len(small) :] = last
        grown[len(small) :, :] = last.T
        small = (grown + grown.T) / 2
        found = np.linalg.eigvalsh(small)[::-1][:d]
        scale = max(float(found[0]), 0.0) if len(found) else 0.0
        if len(found) == len(before) and np.all(np.abs(found - before) <= SETTLED * scale):
            break
        before = found
        block = orthonormal(product, basis, NONE**2 * scale)
        if not block.shape[1] or not scale:
            break
    squares, turned = np.linalg.eigh(small)
    values = np.sqrt(np.maximum(squares[::-1][:d], 0.0))
    kept = int(np.sum(values > NONE * values[0])) if len(values) else 0
    return values[:kept], basis @ turned[:, ::-1][:, :kept]
