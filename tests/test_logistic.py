"""All folds' logistic regressions at once against plain fits, one by one."""

import numpy as np
import pytest

from skarn.operators import classify as K
from skarn.operators import logistic as L


def plain(x, y, w, penalty=0.0):
    """Weighted, penalised logistic regression by undamped steps from 0."""
    z = np.c_[np.ones(len(x)), x]
    b, ridge = np.zeros(z.shape[1]), np.r_[0.0, np.full(x.shape[1], penalty)]
    for _ in range(80):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (w * (p - y)) + ridge * b)
    return b


def table(spark, n=90, d=4, folds=6, seed=3, parts=5):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 20, d) + 0.5 * y[:, None]
    w = np.where(rng.random((n, folds)) < 0.75, rng.uniform(0.2, 3, (n, folds)), 0.0)
    rows = [(f"s{i:03d}", x[i].tolist(), int(y[i]), w[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, embedding array<double>, label int, weights array<double>").repartition(parts), x, y, w


@pytest.mark.parametrize("penalty", [0.0, 1.0, 25.0])
def test_every_fold_equals_its_own_fit(spark, penalty):
    df, x, y, w = table(spark)
    m = L.fit_folds(df, 6, penalty)
    for f in range(6):
        assert np.allclose(m.coef[f], plain(x, y, w[:, f], penalty), atol=1e-6)
    got = {r["sample_id"]: r["scores"] for r in L.scored(df, m).collect()}
    want = 1 / (1 + np.exp(-np.c_[np.ones(len(x)), x] @ m.coef.T))
    assert all(np.allclose(got[f"s{i:03d}"], want[i], atol=1e-12) for i in range(len(x)))


def test_jobs_do_not_grow_with_folds_and_blocks_change_nothing(spark, monkeypatch):
    df, *_ = table(spark, folds=3)
    many, *_ = table(spark, folds=24)
    few, all_ = L.fit_folds(df, 3, 1.0), L.fit_folds(many, 24, 1.0)
    assert all_.jobs <= few.jobs + 3
    monkeypatch.setattr(L, "BLOCK", 36 * 5)  # five folds of four columns at once
    cut = L.fit_folds(many, 24, 1.0)
    assert np.allclose(cut.coef, all_.coef, atol=1e-9) and cut.jobs > all_.jobs


def test_separated_classes_end_and_a_penalty_gives_them_a_fit(spark):
    rows = [(f"s{i}", [float(i), 1e6 * (i % 3)], int(i >= 10), [1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "sample_id string, embedding array<double>, label int, weights array<double>")
    right = lambda m: all((r["scores"][0] > 0.5) == r["label"] for r in L.scored(df, m).collect())
    assert right(L.fit_folds(df, 1)) and right(L.fit_folds(df, 1, 1.0))


def test_odd_rows(spark):
    df, x, y, w = table(spark, n=40, folds=2)
    schema = df.schema
    odd = spark.createDataFrame([("none", None, 1, [1.0, 1.0]), ("unlabelled", [1.0] * 4, None, [1.0, 1.0]), ("idle", [9.0] * 4, 1, [0.0, 0.0])], schema)
    m = L.fit_folds(df.unionByName(odd), 2, 1.0)
    assert np.allclose(m.coef, L.fit_folds(df, 2, 1.0).coef, atol=1e-9)
    got = {r["sample_id"]: r["scores"] for r in L.scored(odd, m).collect()}
    assert got["none"] is None and len(got["unlabelled"]) == len(got["idle"]) == 2
    assert L.scored(df.limit(0), m).count() == 0
    for bad in (df.limit(0), df.unionByName(spark.createDataFrame([("x", [1.0, None, 1.0, 1.0], 1, [1.0, 1.0])], schema)), df.unionByName(spark.createDataFrame([("x", [1.0], 1, [1.0, 1.0])], schema)),
                df.unionByName(spark.createDataFrame([("x", [1.0] * 4, 2, [1.0, 1.0])], schema))):
        with pytest.raises(ValueError):
            L.fit_folds(bad, 2, 1.0)
    with pytest.raises(ValueError, match=r"\[2\]"):
        L.fit_folds(df.selectExpr("embedding", "label", "concat(weights, array(0D)) AS weights"), 3, 1.0)


def test_repeated_rows_weigh_twice(spark):
    df, x, y, w = table(spark, folds=2)
    m = L.fit_folds(df.unionByName(df), 2, 2.0)
    assert np.allclose(m.coef, [plain(x, y, 2 * w[:, f], 2.0) for f in range(2)], atol=1e-6)


@pytest.mark.parametrize("k", [4, None])
def test_a_penalised_baseline(spark, k):
    """Each fold's own medians, deviations and class weights; a column that is constant, as in libraries, says nothing."""
    rng = np.random.default_rng(4)
    n = 40 if k else 16
    y = np.arange(n) % 3 // 2
    x = np.c_[rng.normal(size=(n, 3)) * [1, 40, 3] + y[:, None], np.full(n, 7.0)]
    x[3, 0] = x[5, 2] = x[6, 2] = np.nan
    rows = [(f"s{i:02d}", [None if np.isnan(v) else float(v) for v in x[i]], int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id string, embedding array<double>, label int")
    got = {r["sample_id"]: r for r in K.baseline_oof(df, k, params={"C": 0.5}).collect()}
    fold = np.asarray([got[r[0]]["fold"] for r in rows])
    assert sorted(np.bincount(fold)) == ([10] * 4 if k else [1] * 16)
    for f in set(fold):
        a, t = x[fold != f], x[fold == f]
        mid = [sorted(c[~np.isnan(c)])[((~np.isnan(c)).sum() - 1) // 2] for c in a.T]
        a, t = np.where(np.isnan(a), mid, a), np.where(np.isnan(t), mid, t)
        mean, sd = a.mean(0), a.std(0, ddof=1)
        sd[3] = np.inf
        own = y[fold != f]
        w = len(own) / (2 * np.where(own == 1, (own == 1).sum(), (own == 0).sum()))
        b = plain((a - mean) / sd, own, w, 2.0)
        want = 1 / (1 + np.exp(-np.c_[np.ones(len(t)), (t - mean) / sd] @ b))
        assert np.allclose([got[r[0]]["pred_score"] for r, g in zip(rows, fold, strict=True) if g == f], want, atol=1e-6)


def test_sizes_of_a_learning_curve():
    assert K.curve_sizes(100, 5) == [9, 16, 22, 28, 35, 41, 48, 54, 60, 67, 73, 80]
    assert K.curve_sizes(4, 2) == [2] and K.curve_sizes(3, 3) == [2]
