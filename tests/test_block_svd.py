"""Singular values of few passes against those of the dense matrix."""

import numpy as np
import pytest

from carepath.operators import block_svd, embeddings
from carepath.operators.block_svd import added_products, largest_singular
from carepath.registry.queries import QUERIES


def sparse(spark, matrix):
    rows = [([int(i) for i in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for r in matrix if r.any()]
    return spark.createDataFrame(rows, "indices array<int>, values array<double>").repartition(3)


def random_matrix(n, m, share, seed=0):
    draw = np.random.default_rng(seed)
    return np.where(draw.random((n, m)) < share, draw.exponential(size=(n, m)), 0.0)


@pytest.mark.parametrize("cells", [1 << 21, 64])
def test_products_of_rows(monkeypatch, cells):
    """In one step, and in steps of fewer numbers than a row has."""
    monkeypatch.setattr(block_svd, "CELLS", cells)
    matrix = random_matrix(40, 25, 0.3)
    matrix[3] = 1.0
    matrix = matrix[matrix.any(axis=1)]
    lengths = (matrix != 0).sum(axis=1)
    block, total = np.random.default_rng(1).standard_normal((25, 4)), np.zeros((25, 4))
    added_products(np.nonzero(matrix)[1], matrix[matrix != 0], np.cumsum(lengths) - lengths, block, total)
    assert np.allclose(total, matrix.T @ matrix @ block)


def test_values_of_a_flat_spectrum(spark):
    """Random entries have no gaps between their singular values: the hard case. More columns than the space has vectors."""
    matrix = random_matrix(900, 700, 0.2)
    values, vectors = largest_singular(sparse(spark, matrix), 700, 30)
    assert values == pytest.approx(np.linalg.svd(matrix)[1][:30], rel=1e-3)
    assert np.allclose(vectors.T @ vectors, np.eye(30), atol=1e-9)
    assert np.allclose(np.linalg.norm(matrix @ vectors, axis=0), values)


def test_low_rank_ties_and_slices(spark, monkeypatch):
    """Fewer directions than asked for, equal values, and a block that is taken in slices."""
    monkeypatch.setattr(block_svd, "HELD", 100)
    monkeypatch.setattr(block_svd, "COLUMNS", 7)
    draw = np.random.default_rng(5)
    left, right = np.linalg.qr(draw.standard_normal((60, 5)))[0], np.linalg.qr(draw.standard_normal((40, 5)))[0]
    values, vectors = largest_singular(sparse(spark, left * [9.0, 4.0, 4.0, 1.0, 0.5] @ right.T), 40, 8)
    assert values == pytest.approx([9.0, 4.0, 4.0, 1.0, 0.5], abs=1e-7)
    assert np.allclose(right @ (right.T @ vectors), vectors, atol=1e-6)


def test_passes_follow_neither_vectors_nor_rows(spark, monkeypatch):
    passes = []
    product = block_svd.gram_product
    monkeypatch.setattr(block_svd, "gram_product", lambda *given: passes.append(1) or product(*given))
    largest_singular(sparse(spark, random_matrix(500, 400, 0.1)), 400, 20)
    assert len(passes) <= 6
    passes.clear()
    largest_singular(sparse(spark, random_matrix(50, 20, 0.3)), 20, 20)
    assert len(passes) <= 2  # the first block spans all columns


def test_empty_matrix_and_nulls(spark):
    empty = spark.createDataFrame([], "code string, context string, ppmi double")
    found = embeddings.decompose(empty, "code", "context", "ppmi")
    assert (found.values, found.columns) == ([], []) and found.project(empty, "code").count() == 0
    cells = spark.createDataFrame([("a", "x", 3.0), ("b", "x", None), ("b", "y", 4.0)], "code string, context string, ppmi double")
    assert embeddings.decompose(cells, "code", "context", "ppmi").values == pytest.approx([4.0, 3.0])


def test_spectrum_query(spark):
    """The registered query against the dense matrix of all codes."""
    folder = "/root/testdata/sf0.01"
    cells = QUERIES["ppmi"](spark, folder).toPandas()
    dense = cells.pivot(index="code", columns="context", values="ppmi").fillna(0.0).to_numpy(dtype=float)
    found = {r["component"]: r["singular_value"] for r in QUERIES["code_spectrum"](spark, folder).collect()}
    wanted = np.linalg.svd(dense)[1][:30]
    assert [found[k] for k in range(1, 31)] == pytest.approx(list(wanted), rel=1e-3)
