"""Neighbour descent against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from skarn.operators import descent as D


def exact(x, k, metric):
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
    else:
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, : k - 1]


def table(spark, x):
    return spark.createDataFrame([(f"v{i:05d}", r.tolist(), 1) for i, r in enumerate(x)], "cell_id string, embedding array<double>, d int").repartition(4)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_recall_with_under_a_tenth_of_the_pairs(spark, metric):
    rng = np.random.default_rng(4)
    n, k = 5000, 10
    x = np.c_[rng.normal(size=(n, 3)), np.ones(n)] @ rng.normal(size=(4, 16)) + 0.02 * rng.normal(size=(n, 16))
    edges, figures = D.knn_descent(table(spark, x), k, metric)
    got: dict = {}
    for r in edges.collect():
        got.setdefault(int(r["i"][1:]), set()).add(int(r["j"][1:]))
    want = exact(x, k, metric)
    recall = np.mean([len(got[i] & set(want[i].tolist())) / (k - 1) for i in range(n)])
    assert recall >= 0.95 and figures["share_of_pairs"] < 0.1, (recall, figures)
    assert figures["longest_list"] <= k - 1 + D.REVERSE and all(len(s) == k - 1 for s in got.values())


def test_copies_hubs_and_small_tables(spark):
    """A third of the rows equal, one vector near to all: lists stay bounded, distances right, ranks by distance and id."""
    rng = np.random.default_rng(1)
    x = np.r_[np.zeros((100, 4)), rng.normal(size=(200, 4)), [[0.01] * 4]]
    edges, figures = D.knn_descent(table(spark, x), 6)
    rows = edges.collect()
    assert len(rows) == 5 * len(x) and figures["longest_list"] <= 5 + D.REVERSE
    for r in rows:
        i, j = int(r["i"][1:]), int(r["j"][1:])
        assert i != j and abs(r["distance"] - np.linalg.norm(x[i] - x[j])) < 1e-5
    by: dict = {}
    for r in rows:
        by.setdefault(r["i"], []).append((r["rank"], r["distance"], r["j"]))
    assert all([t[1:] for t in sorted(v)] == sorted(t[1:] for t in v) and sorted(t[0] for t in v) == [1, 2, 3, 4, 5] for v in by.values())
    assert all(d == 0 for i, v in by.items() if int(i[1:]) < 100 for _, d, _ in v)
    for n in (0, 1, 2, 4):
        few, figures = D.knn_descent(table(spark, rng.normal(size=(n, 3))) if n else table(spark, x).where("false"), 6)
        assert few.count() == n * (n - 1) and figures["share_of_pairs"] <= 1.0


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_many_lists_at_once_send_only_what_can_enter(metric, monkeypatch):
    """Lists of 1 to 5 members cut by batches: pairs with a new member and no common leaf, none beyond the bound of the member they are for; few calls for many lists."""
    rng = np.random.default_rng(3)
    size = rng.integers(1, 6, 200)
    p = np.repeat(np.arange(200), size)
    n = len(p)
    u, x, new, leaves = rng.permutation(n), rng.normal(size=(n, 3)).astype("f4"), rng.random(n) < 0.5, rng.integers(0, 4, (n, 2))
    bound = np.where(rng.random(n) < 0.3, np.inf, rng.uniform(0, 2, n))
    t = pa.table({"p": p, "u": u, "embedding": list(x), "new": new, "bound": bound, "leaves": list(leaves)})
    want, count = {}, 0
    for a in range(n):
        for b in range(n):
            if a != b and p[a] == p[b] and (new[a] or new[b]) and not (leaves[a] == leaves[b]).any():
                v, w = x[a].astype(float), x[b].astype(float)
                d = np.linalg.norm(v - w) if metric == "euclidean" else 1 - v @ w / np.sqrt(v @ v * (w @ w))
                count += 1
                if d <= bound[a]:
                    want[u[a], u[b]] = d
    calls, distances = [0], D._distances
    monkeypatch.setattr(D, "_distances", lambda y, m: calls.append(1) or distances(y, m))
    whole = list(D._whole(t.to_batches(max_chunksize=64)))
    assert sum(len(w) for w in whole) == n and all(set(a.column("p").to_pylist()).isdisjoint(b.column("p").to_pylist()) for a, b in zip(whole, whole[1:], strict=False))
    rows = [r for w in whole for b in D._compared(w, 9, metric) for r in b.to_pylist()]
    got = {(r["i"], r["j"]): r["d"] for r in rows if r["i"] is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert sum(r["d"] for r in rows if r["i"] is None) * 2 == count and sum(calls) <= 5 * len(whole)
