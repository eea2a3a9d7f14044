"""Decompositions against numpy, on small tables."""

import numpy as np
import pytest

from skarn.operators import axes
from skarn.operators import features as V


@pytest.mark.parametrize("exact", [512, 4])
@pytest.mark.parametrize("centre", [True, False])
def test_projections_are_those_of_the_singular_vectors(spark, monkeypatch, exact, centre):
    """By the whole matrix, and by a subspace where it would be too large."""
    monkeypatch.setattr(V, "EXACT", exact)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 30)) * (2.0 ** -np.arange(30)) @ np.linalg.qr(rng.normal(size=(30, 30)))[0] + 0.3
    df = spark.createDataFrame([(str(i), r.tolist(), "b") for i, r in enumerate(x)], "cell_id string, embedding array<double>, batch string").repartition(3)
    out, variance = V._project(df, 5, centre)
    y = x - x.mean(0) if centre else x
    u, s, w = np.linalg.svd(y, full_matrices=False)
    got = {r["cell_id"]: r["embedding"] for r in out.collect()}
    got = np.asarray([got[str(i)] for i in range(120)])
    assert out.columns == df.columns and np.allclose(np.abs(got), np.abs(y @ w[:5].T), atol=1e-6)
    assert np.allclose(variance, s[:5] ** 2 / 119)
    load = np.linalg.lstsq(y, got, rcond=None)[0]
    assert all(load[np.abs(load[:, k]).argmax(), k] > 0 for k in range(5))  # signs are fixed


def test_dense_vectors_and_projections_of_sparse_values(spark):
    expr = spark.createDataFrame([("a", "g2", 2.0), ("a", "g1", 1.0), ("b", "g3", -3.0), ("b", "other", 9.0)], "cell_id string, gene_id string, value double")
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cell_id string")
    genes = spark.createDataFrame([("g3",), ("g1",), ("g2",), ("g1",)], "gene_id string")
    got = {r["cell_id"]: r["embedding"] for r in V.hvg_embedding(expr, cells, genes).collect()}
    assert got == {"a": [1.0, 2.0, 0.0], "b": [0.0, 0.0, -3.0], "c": [0.0, 0.0, 0.0]}
    one = {r["cell_id"]: np.asarray(r["embedding"]) for r in V.random_projection(expr, 4).collect()}
    two = {r["cell_id"]: np.asarray(r["embedding"]) for r in V.random_projection(expr.withColumn("value", 2 * expr.value), 4).collect()}
    assert all(np.allclose(2 * one[k], two[k]) for k in "ab") and len(one["a"]) == 4


def sparse_table(spark, x):
    cells, genes = np.nonzero(x)
    expr = spark.createDataFrame([(f"c{i}", f"g{j:05d}", float(x[i, j])) for i, j in zip(cells.tolist(), genes.tolist())], "cell_id string, gene_id string, value double").repartition(5)
    return expr, spark.createDataFrame([(f"c{i}",) for i in range(len(x))], "cell_id string"), spark.createDataFrame([(f"g{j:05d}",) for j in range(x.shape[1])], "gene_id string")


@pytest.mark.parametrize("centre", [True, False])
@pytest.mark.parametrize("exact", [512, 8])
def test_sparse_rows_give_the_singular_vectors(spark, centre, exact):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((90, 60)) < 0.2, rng.normal(size=(90, 60)) + 1, 0) * (1.1 ** -np.arange(60))
    x[7] = 0  # a cell without stored values
    x[:, 11] = 0  # a gene that no cell has
    out, found = axes.sparse_axes(*sparse_table(spark, x), 6, centre, exact)
    y = x - x.mean(0) if centre else x
    s, w = np.linalg.svd(y, full_matrices=False)[1:]
    got = {r["cell_id"]: r["embedding"] for r in out.collect()}
    got = np.asarray([got[f"c{i}"] for i in range(90)])
    assert np.allclose(found.value, s[:6] ** 2) and np.allclose(np.abs(got), np.abs(y @ w[:6].T), atol=1e-6)
    assert (found.residual <= 1e-8 * s[0] ** 2).all() and (found.rounds == 1) == (exact == 512)


@pytest.mark.parametrize("centre", [True, False])
def test_a_flat_spectrum_of_4096_columns(spark, centre):
    """No structure at all: neighbouring values differ by some hundredths, so only residuals tell when axes have settled. Rows are never made dense."""
    rng = np.random.default_rng(5)
    x = np.zeros((300, 4096))
    for i in range(300):
        x[i, rng.choice(4096, 60, replace=False)] = rng.integers(1, 6, 60)
    out, found = axes.sparse_axes(*sparse_table(spark, x), 20, centre)
    y = x - x.mean(0) if centre else x
    s = np.linalg.svd(y, compute_uv=False)
    assert np.allclose(found.value, s[:20] ** 2, rtol=1e-9) and found.rounds > 3 and (found.residual <= 1e-8 * s[0] ** 2).all()
    got = np.asarray([r["embedding"] for r in out.collect()])
    assert np.allclose(np.sort((got**2).sum(0)), np.sort(s[:20] ** 2))


def test_axes_that_do_not_settle_are_an_error():
    a = np.diag(np.linspace(1, 0.99, 400))
    with pytest.raises(ArithmeticError, match="not settled"):
        axes.solve(lambda q: a @ q, 400, 5, 8, most=2)
    found = axes.solve(lambda q: a @ q, 400, 5, 8)
    assert np.allclose(found.value, np.linspace(1, 0.99, 400)[:5]) and np.allclose(np.abs(found.vectors[np.arange(5), np.arange(5)]), 1, atol=1e-5)
    low = np.outer(np.arange(700.0), np.arange(700.0))  # of rank one
    assert np.allclose(axes.solve(lambda q: low @ q, 700, 3, 8).value, [(np.arange(700.0) ** 2).sum(), 0, 0], atol=1e-3)


def test_tables_without_cells_or_genes(spark):
    expr, cells, genes = sparse_table(spark, np.eye(3))
    none = expr.where("false")
    assert axes.sparse_axes(none, cells.where("false"), genes, 2, True)[0].collect() == []
    got = axes.sparse_axes(none, cells, genes, 2, False)
    assert [r["embedding"] for r in got[0].collect()] == [[0.0, 0.0]] * 3 and got[1].value.tolist() == [0, 0]
    assert [r["embedding"] for r in axes.sparse_axes(expr, cells, genes.where("false"), 2, True)[0].collect()] == [[]] * 3


def test_partial_products_travel_as_chunks(spark, monkeypatch):
    """A pass over 300 columns brings at most 300 / 64 rows, not one a column, to the driver; columns without values are zero rows."""
    monkeypatch.setattr(axes, "CHUNK", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 300)) * (rng.random((80, 300)) < 0.2)
    x[:, 128:192] = 0
    rows = spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in x], "pos array<int>, value array<double>").repartition(5)
    q, found = rng.normal(size=(300, 4)), []
    to = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda df: found.append(to(df)) or found[-1])
    assert np.allclose(axes.sparse_product(rows, np.zeros(300))(q), x.T @ (x @ q))
    assert found[0].num_rows == 4  # chunks 0, 1, 3 and 4; none of the empty columns
