"""Exact neighbours: the sieve in single precision against all distances in double, and how few pairs it leaves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import graph


def plain(ia, x, ib, y, n, metric, most):
    d = np.round(graph.distances(x, y, metric), 6) + 0.0
    d[np.isnan(d) | (ia[:, None] == ib[None, :])] = np.inf
    order = np.argsort(ib, kind="stable")
    near = [order[np.argsort(row[order], kind="stable")[:n]] for row in d]
    return [[(j, d[i, j]) for j in js if np.isfinite(d[i, j]) and d[i, j] <= most[i]] for i, js in enumerate(near)]


def _cases():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(1200, 16)), rng.normal(size=(11_000, 16))
    yield "plain", x, y, np.full(1200, np.inf)
    yield "bounded", x, y, rng.uniform(0, 1, 1200)
    copies = y.copy()
    copies[:4000] = y[0]
    yield "copies", np.vstack([copies[:50], x[50:]]), copies, np.full(1200, np.inf)
    odd, own = y.copy(), x.copy()
    odd[5], odd[7, 2], odd[8, 1], own[3], own[9, 1] = 0, np.nan, -np.inf, 0, np.inf
    yield "odd", own, odd, np.full(1200, np.inf)
    yield "ties", np.round(x[:, :2]), np.round(y[:, :2]), np.full(1200, np.inf)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("case", list(_cases()), ids=lambda c: c[0])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_nearest_are_those_of_all_distances(case, metric):
    name, x, y, most = case
    ia, ib = np.array([str(i) for i in range(len(x))], object), np.array([str(i) for i in np.random.default_rng(1).permutation(len(y))], object)
    got = [[] for _ in x]
    for p, q, d in graph._nearest(ia, x, ib, y, 14, metric, True, most):
        for i, j, v in zip(p, q, d, strict=True):
            got[i].append((j, v))
    assert got == plain(ia, x, ib, y, 14, metric, most)


def test_few_pairs_are_compared_in_double(monkeypatch):
    seen, distances, pairwise = [0], graph.distances, graph._pairwise
    monkeypatch.setattr(graph, "distances", lambda x, y, m: seen.append(len(x) * len(y)) or distances(x, y, m))
    monkeypatch.setattr(graph, "_pairwise", lambda x, y, m: seen.append(len(x)) or pairwise(x, y, m))
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(1024, 64)), rng.normal(size=(20_000, 64))
    ids = np.array([str(i) for i in range(20_000)], object)
    assert sum(len(p) for p, _, _ in graph._nearest(ids[:1024], x, ids, y, 14, "cosine", False)) == 1024 * 14
    assert sum(seen) < 0.1 * 1024 * 20_000


def test_groups_of_block_pairs_hold_every_pair_once(spark):
    """20 blocks of 3 rows on either side: each pair of blocks once, of each block of the left in several tasks' groups."""
    emb = spark.createDataFrame([(str(i), [float(i)], "") for i in range(60)], "cell_id string, embedding array<double>, cat string")
    rows = graph.block_pairs(emb, emb, block_rows=3).collect()
    assert sorted((a["cell_id"], b["cell_id"]) for r in rows for a in r["a"] for b in r["b"]) == sorted((str(i), str(j)) for i in range(60) for j in range(60))
    assert len({r["i"] for r in rows}) == len({tuple(x["cell_id"] for x in r["a"]) for r in rows})


def test_distance_sums_by_category():
    """Against all distances at once, over several slices and a category without rows."""
    from skarn.operators.embed_metrics import _distance_sums

    rng = np.random.default_rng(4)
    x, y, at = rng.normal(size=(600, 8)), rng.normal(size=(5000, 8)), rng.integers(0, 3, 5000)
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    assert np.allclose(_distance_sums(x, y, at, 4), np.stack([d[:, at == k].sum(1) for k in range(4)], 1))


def test_distance_runs_over_slices():
    """Runs that begin inside, at and beyond the edges of slices."""
    from skarn.operators.embed_metrics import _distance_runs

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(300, 8)), rng.normal(size=(5000, 8))
    starts = np.array([0, 1, 2047, 2048, 4096, 4999])
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    assert np.allclose(_distance_runs(x, y, starts), np.add.reduceat(d, starts, axis=1))


def test_a_suite_computes_distances_once(spark, monkeypatch):
    """The three silhouettes of one pass equal those of a pass each; two groups, blocks of 20, a null label, a batch of one; the suite pairs all its blocks for them once."""
    from skarn.operators import embed_metrics as M

    rng = np.random.default_rng(6)
    rows = [(f"g{i % 2}", str(i), rng.normal(size=5).tolist(), None if i % 31 == 0 else f"L{i % 3}", "B9" if i == 7 else f"B{i % 5 % 2}") for i in range(120)]
    emb = spark.createDataFrame(rows, "run string, cell_id string, embedding array<double>, label string, batch string")
    sums = M.distance_sums(emb, by=["run"], block_rows=20).cache()
    for kind, keys, plain in (("label", ["run"], M.silhouette_samples(emb, "label", ["run"])), ("batch", ["run"], M.silhouette_samples(emb, "batch", ["run"])), ("within", ["run", "label"], M.silhouette_samples(emb, "batch", ["run", "label"]))):
        got, want = ({tuple(r)[:-1]: r["s"] for r in t.collect()} for t in (M._silhouettes(sums.where(f"kind = '{kind}'"), keys), plain))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), kind
    paired, block_pairs = [], M.graph.block_pairs
    monkeypatch.setattr(M.graph, "block_pairs", lambda a, b, within=None, block_rows=None: paired.append("cat" in a.columns and a.schema["cat"].dataType.typeName()) or block_pairs(a, b, within, block_rows))
    monkeypatch.setattr(M, "silhouette_samples", None)
    values = {(r["run"], r["metric"]): r for r in M.embedding_suite(emb, k=5, clusters=emb.select("run", "cell_id", F.col("label").alias("community")), by=["run"]).collect()}
    assert paired.count("struct") == 1 and not [r for r in values.values() if r["error"]]


def test_distances_are_computed_once_for_both_ends(spark, monkeypatch):
    """Of 5 blocks and of 4 each meets itself and half of the others; both ends get their sums."""
    from skarn.operators import embed_metrics as M

    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(600, 5)), rng.normal(size=(2500, 5))
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    xs, ys = np.array([0, 3, 255, 256, 590]), np.array([0, 1, 2048, 2400])
    there, back = M._distance_both(x, y, xs, ys)
    assert np.allclose(there, np.add.reduceat(d, ys, axis=1)) and np.allclose(back, np.add.reduceat(d.T, xs, axis=1))
    emb = spark.createDataFrame([(f"c{i}", v.tolist(), f"L{i % 3}", f"B{i % 2}") for i, v in enumerate(x[:100])], "cell_id string, embedding array<double>, label string, batch string")
    for rows, pairs in ((20, 15), (25, 10)):
        met = []
        of = M.graph.once
        monkeypatch.setattr(M.graph, "once", lambda pairs, of=of: met.append(of(pairs)) or met[-1])
        t = M.distance_sums(emb, block_rows=rows).where("kind = 'label'").cache()
        assert met[0].count() == pairs
        got = {(r["i"], r["other"]): (r["d"], r["n"]) for r in t.collect()}
        e = np.sqrt(((x[:100, None] - x[None, :100]) ** 2).sum(2))
        assert len(got) == 300 and all(np.isclose(got[f"c{i}", f"L{k}"][0], e[i, k::3].sum()) and got[f"c{i}", f"L{k}"][1] == len(e[i, k::3]) for i in range(100) for k in range(3))
        monkeypatch.setattr(M.graph, "once", of)


def test_a_benchmark_takes_isolated_labels_from_the_suites_silhouettes(spark, monkeypatch):
    """Label L0 is in one batch, the others in two: its silhouettes alone are averaged; there is no pass over the distances beside the suite's."""
    from skarn.operators import embed_metrics as M

    rng = np.random.default_rng(9)
    emb = spark.createDataFrame([("k", f"c{i}", rng.normal(size=4).tolist(), f"B{0 if i % 3 == 0 else i % 2}", f"L{i % 3}") for i in range(60)], "key string, cell_id string, embedding array<double>, batch string, label string")
    samples, more = M.silhouette_samples(emb, "label", ["key"]), {}
    monkeypatch.setattr(M, "silhouette_samples", None)
    monkeypatch.setattr(M, "embedding_suite", lambda *a, **b: more.update(b["more"]) or spark.createDataFrame([], "key string, metric string, value double, error string"))
    got = M.benchmark(emb).collect()
    assert {r["metric"] for r in got} == {"nmi_kmeans", "ari_kmeans"} and not [r for r in got if r["error"]]
    (key, value), = more["isolated_label_asw"](samples).collect()
    assert key == "k" and np.isclose(value, (np.mean([r["s"] for r in samples.collect() if r["cat"] == "L0"]) + 1) / 2)
