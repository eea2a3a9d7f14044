"""Operators that SQL doesn't hold, against plain numpy versions or hand counts on small tables."""

import hashlib
import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import classify as K
from skarn.operators import embed_metrics as M
from skarn.operators import features as V
from skarn.operators import graph as N
from skarn.operators import report as R
from skarn.operators import splits as P


def table(spark, n=60, d=5, seed=3, shift=0.6):
    rng = np.random.default_rng(seed)
    lab, bat = rng.integers(0, 3, n), rng.integers(0, 2, n)
    x = rng.normal(size=(n, d)) + shift * lab[:, None]
    rows = [(f"c{i:02d}", x[i].tolist(), f"L{lab[i]}", f"B{bat[i]}") for i in range(n)]
    return spark.createDataFrame(rows, "cell_id string, embedding array<double>, label string, batch string").repartition(3), rows


def cosine_knn(rows, k):
    """i -> [(distance, j)] of the k - 1 nearest others."""
    x = np.asarray([r[1] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 6)
    ids = [r[0] for r in rows]
    return {a: sorted((d[i, j], b) for j, b in enumerate(ids) if a != b)[: k - 1] for i, a in enumerate(ids)}


def one(df):
    return df.first()[0]


# --- neighbours ---


def test_equal_vectors_keep_only_the_smallest_ids(spark):
    e = spark.createDataFrame([(f"c{i:03d}", [1.0, 2.0]) for i in range(90)], "cell_id string, embedding array<double>")
    got = N.knn(e, 4, block_rows=20).collect()
    assert len(got) == 90 * 3 and {r["j"] for r in got if r["i"] == "c050"} == {"c000", "c001", "c002"} and {r["j"] for r in got if r["i"] == "c001"} == {"c000", "c002", "c003"}


@pytest.mark.parametrize("slices", [1, 3, 1000])
def test_nearest_whatever_the_slices(monkeypatch, slices):
    monkeypatch.setattr(N, "SLICE", slices)
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (40, 2)).astype(float)  # many ties
    x[7] = np.nan
    ids = np.asarray([f"c{i:02d}" for i in rng.permutation(40)], dtype=object)
    got = sorted((ids[p], ids[q], d) for pp, qq, dd in N._nearest(ids, x, ids, x, 5, "euclidean", True) for p, q, d in zip(pp, qq, dd, strict=True))
    want = []
    for i in range(40):
        near = sorted((round(float(np.linalg.norm(x[i] - x[j])), 6), ids[j]) for j in range(40) if j != i and i != 7 and j != 7)[:5]
        want += [(ids[i], j, d) for d, j in near]
    assert got == sorted(want)


def test_approximate_neighbours_are_real_and_their_recall_is_counted(spark):
    e, rows = table(spark)
    x = {r[0]: np.asarray(r[1]) for r in rows}
    found = N.knn_approx(e, 6, 2.0, 4, 20.0).collect()
    assert found and all(abs(np.linalg.norm(x[r["i"]] - x[r["j"]]) - r["distance"]) < 1e-9 for r in found)
    want = {(i, j) for i in x for _, j in sorted((np.linalg.norm(x[i] - x[j]), j) for j in x if j != i)[:5]}
    share = len(want & {(r["i"], r["j"]) for r in found}) / len(want)
    assert share > 0.7 and one(N.recall(N.knn_approx(e, 6, 2.0, 4, 20.0), N.knn(e, 6, "euclidean"))) == pytest.approx(share, abs=0.02)


def test_connectivities(spark):
    e, rows = table(spark)
    w = {}
    for i, near in cosine_knn(rows, 8).items():
        d = np.asarray([x for x, _ in near])
        rho = d[d > 0].min()
        lo, hi = 1e-12, 1e3
        for _ in range(200):
            s = (lo + hi) / 2
            lo, hi = (s, hi) if np.exp(-np.maximum(d - rho, 0) / s).sum() < math.log2(8) else (lo, s)
        w |= {(i, j): float(np.exp(-max(x - rho, 0) / s)) for x, j in near}
    want = {(i, j): w.get((i, j), 0) + w.get((j, i), 0) - w.get((i, j), 0) * w.get((j, i), 0) for a in w for i, j in (a, a[::-1])}
    got = {(r["i"], r["j"]): r["weight"] for r in N.connectivities(N.knn(e, 8), 8).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_communities_by_modularity(spark):
    """The number is that of its definition, and three far groups are found whole, in one graph and in two graphs at once."""
    e, rows = table(spark, shift=0.0)
    far = e.withColumn("embedding", F.transform("embedding", lambda v, i: v * 0.1 + F.when(i == F.substring("label", 2, 1).cast("int"), 9.0).otherwise(0.0)))
    edges = N.connectivities(N.knn(far, 8), 8).cache()
    found = N.communities(edges, 0.3)
    comm = {r["cell_id"]: r["community"] for r in found.collect()}
    lab = {r[0]: r[2] for r in rows}
    w = {(r["i"], r["j"]): r["weight"] for r in edges.collect()}
    m = sum(w.values())
    deg = {i: sum(v for (a, _), v in w.items() if a == i) for i in comm}
    q = sum(w.get((a, b), 0) / m - deg[a] * deg[b] / m**2 for a in comm for b in comm if comm[a] == comm[b])
    assert one(N.modularity(edges, found)) == pytest.approx(q, abs=1e-9) and q > 0.45
    assert all(len({lab[i] for i in comm if comm[i] == c}) == 1 for c in set(comm.values()))
    two = edges.unionByName(edges.select(F.concat(F.lit("z"), "i").alias("i"), F.concat(F.lit("z"), "j").alias("j"), "weight"))
    g = found.select(F.col("cell_id").alias("i"), F.lit("a").alias("g")).unionByName(found.select(F.concat(F.lit("z"), "cell_id").alias("i"), F.lit("b").alias("g")))
    both = {r["cell_id"]: r["community"] for r in N.communities(two, 0.3, groups=g).collect()}
    assert all(both[i] == comm[i] for i in comm)  # the other graph's weight doesn't count


# --- metrics of embeddings ---


@pytest.mark.parametrize("kind", ["group", "number"])
def test_component_regression(spark, kind):
    e, rows = table(spark)
    x = np.asarray([r[1] for r in rows])
    y = x - x.mean(0)
    _, s, w = np.linalg.svd(y, full_matrices=False)
    pc, var = y @ w[:3].T, s[:3] ** 2
    c = np.asarray([r[3] for r in rows]) if kind == "group" else np.asarray([float(r[0][1:]) ** 2 for r in rows])
    if kind == "group":
        r2 = [sum((c == b).sum() * pc[c == b, k].mean() ** 2 for b in set(c)) / (pc[:, k] ** 2).sum() for k in range(3)]
    else:
        r2 = [np.corrcoef(pc[:, k], c)[0, 1] ** 2 for k in range(3)]
    e = e if kind == "group" else e.withColumn("batch", F.pow(F.substring("cell_id", 2, 9).cast("double"), 2))
    want = float((np.asarray(r2) * var).sum() / var.sum())
    assert one(M.pcr(e, "batch", 3)) == pytest.approx(want, abs=1e-6)
    twice = e.withColumn("run", F.lit(0)).unionByName(e.withColumn("run", F.lit(1)))
    assert [round(r["pcr"], 6) for r in M.pcr(twice, "batch", 3, ["run"]).collect()] == [round(want, 6)] * 2


def brute_lisi(rows, k):
    bat, out = {r[0]: r[3] for r in rows}, []
    for near in cosine_knn(rows, k).values():
        d = np.asarray([x for x, _ in near])
        lo, hi = 0.0, 1e6
        for _ in range(200):
            beta = (lo + hi) / 2
            p = np.exp(-(d - d.min()) * beta)
            p /= p.sum()
            high = -(p * np.log(np.maximum(p, 1e-300))).sum() > math.log(max(k // 3, 1))
            lo, hi = (beta, hi) if high else (lo, beta)
        out.append(1 / sum(sum(p[i] for i, (_, j) in enumerate(near) if bat[j] == b) ** 2 for b in set(bat.values())))
    return float(np.median(out))


def test_lisi(spark):
    e, rows = table(spark)
    edges = N.knn(e, 10)
    m = brute_lisi(rows, 10)
    assert one(M.lisi(edges, e, "batch", "i", 10)) == pytest.approx(m - 1, abs=1e-5)
    assert one(M.lisi(edges, e, "batch", "c", 10)) == pytest.approx(2 - m, abs=1e-5)
    assert one(M.lisi(edges, e.withColumn("batch", F.lit("one")), "batch", "i", 10)) is None


def chi2_tail(x, df):
    """By adding up the density."""
    t = np.linspace(1e-9, x, 400_001)
    f = t ** (df / 2 - 1) * np.exp(-t / 2) / (2 ** (df / 2) * math.gamma(df / 2))
    return 1 - float(np.trapezoid(f, t))


def test_kbet_share(spark):
    e, _ = table(spark, n=90)
    e = e.withColumn("batch", F.concat(F.lit("B"), F.pmod(F.xxhash64("cell_id"), F.lit(3))))
    s = M.kbet_statistic(e, k=8).collect()
    assert {r["df"] for r in s} == {2}
    labels = sorted({r["label"] for r in s})
    want = np.mean([np.mean([math.exp(-r["chi2"] / 2) >= 0.05 for r in s if r["label"] == v]) for v in labels])  # the tail of two degrees is exp(-x / 2)
    assert one(M.kbet_per_label(e, k=8)) == pytest.approx(want) and 0 < want <= 1
    assert chi2_tail(5.0, 3) == pytest.approx(one(spark.createDataFrame([(5.0, 3.0)], "x double, k double").select(M.chi2_sf("x", "k"))), abs=1e-5)


def values(df, *by):
    return {(*[r[c] for c in by], r["metric"]): r["value"] for r in df.collect()}


def test_suite_holds_each_metric_and_reports_failures(spark, monkeypatch):
    e, _ = table(spark)
    edges, cells = N.knn(e, 8), e.drop("embedding")
    fixed = e.select("cell_id", F.concat(F.lit("K"), F.pmod(F.xxhash64("cell_id"), F.lit(4))).alias("community"))
    got = values(M.embedding_suite(e, k=8, clusters=fixed))
    c = cells.join(fixed, "cell_id")
    want = {"nmi": M.nmi(c, "community", "label"), "ari": M.ari(c, "community", "label"), "asw_label": M.silhouette(e, "label"), "asw_batch": M.silhouette(e, "batch"), "batch_asw": M.batch_asw(e), "graph_connectivity": M.graph_connectivity(edges, cells),
            "purity_label": M.knn_purity(edges, cells, "label"), "purity_batch": M.knn_purity(edges, cells, "batch"), "ilisi": M.lisi(edges, cells, "batch", "i", 8), "clisi": M.lisi(edges, cells, "label", "c", 8), "kbet": M.kbet_per_label(e, k=8), "pcr": M.pcr(e, "batch"), "batch_pred_acc": M.batch_pred_acc(e, k=8)}
    assert set(got) == {(k,) for k in want} and all(got[(k,)] == pytest.approx(one(v), abs=1e-9) for k, v in want.items())

    def fails(*a, **k):
        raise ValueError("no such column")

    monkeypatch.setattr(M, "pcr", fails)
    monkeypatch.setattr(M, "kbet_per_label", lambda emb, *a, **k: emb.select(F.raise_error(F.lit("no numbers"))))
    rows = {r["metric"]: r for r in M.embedding_suite(e, k=8, clusters=fixed).collect()}
    assert rows["pcr"]["error"] == "ValueError: no such column" and rows["pcr"]["value"] is None
    assert rows["kbet"]["error"] and rows["ari"]["error"] is None and len(rows) == 13
    alone = values(M.embedding_suite(e.withColumn("batch", F.lit("one")), k=8, clusters=fixed))
    assert {k for (k,) in alone} == {"nmi", "ari", "asw_label", "graph_connectivity", "purity_label", "clisi"}


def test_bootstrapped_runs_equal_the_suite_of_each_run(spark):
    """All metrics but the split by hash of ids, and clusters, which hashes move too: those are asked to be there."""
    e, _ = table(spark)
    runs = M.bootstrap_suite(e, 2, 40, "batch", 7, k=8).cache()
    got = values(runs, "run")
    x = P.bootstrap_samples(e, 2, 40, "batch", 7)
    hashed = {"nmi", "ari", "batch_pred_acc"}
    for run in (1,):
        alone = values(M.embedding_suite(x.where(F.col("run") == run).drop("run"), k=8))
        assert {m for r, m in got if r == run} == {m for (m,) in alone}
        assert all(got[(run, m)] == pytest.approx(v, abs=1e-9) for (m,), v in alone.items() if m not in hashed)
    for r in M.bootstrap_summary(runs).collect():
        v = [got[(run, r["metric"])] for run in (0, 1)]
        assert r["n_runs"] == 2 and r["n_failed"] == 0 and r["mean"] == pytest.approx(np.mean(v)) and r["sd"] == pytest.approx(np.std(v, ddof=1)) and r["median"] == pytest.approx(np.median(v))


def test_a_sample_is_written_before_it_is_ranked(spark, monkeypatch):
    """The ranking reads about the sampled rows alone, not the whole table again for every run; a run has the first of each class by md5, or all of a small table."""
    from hashlib import md5

    rows = [(f"c{i}", f"g{i % 3 and 1}") for i in range(600)]
    df, seen, ranked = spark.createDataFrame(rows, "cell_id string, g string"), [], P.ranked
    monkeypatch.setattr(P, "ranked", lambda x, *a: seen.append(x) or ranked(x, *a))
    for n in (30, 1_000):
        seen.clear()
        got = {(r["run"], r["cell_id"]) for r in P.bootstrap_samples(df, 4, n, "g", 5).collect()}
        of = lambda run, g: sorted((c for c, x in rows if x == g), key=lambda c: md5(f"{c}:{run + 5}".encode()).hexdigest())
        assert got == {(run, c) for run in range(4) for g, k in (("g0", n // 3), ("g1", n - n // 3)) for c in of(run, g)[:k]}
        plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
        assert len(seen) == 1 and "Generate" not in plan and "md5" not in plan and seen[0].count() <= 4 * n + 40


def test_benchmark_of_two_embeddings(spark):
    """Of unlike lengths; each key as if it were alone."""
    e, rows = table(spark, shift=4.0)
    cut = e.withColumn("embedding", F.slice("embedding", 1, 2))
    got = values(M.benchmark(e.withColumn("key", F.lit("a")).unionByName(cut.withColumn("key", F.lit("b")))), "key")
    assert {k for k, _ in got} == {"a", "b"} and got[("a", "nmi_kmeans")] > 0.9
    for key, df in (("a", e), ("b", cut)):
        few = df.groupBy("label").agg(F.countDistinct("batch").alias("b"))
        assert few.select("b").distinct().count() == 1  # so every label counts as isolated
        assert got[(key, "isolated_label_asw")] == pytest.approx(got[(key, "asw_label")]) == pytest.approx(one(M.silhouette(df, "label")))
        assert got[(key, "purity_label")] == pytest.approx(one(M.knn_purity(N.knn(df), df, "label")))


# --- classifiers ---


def newton(x, y, w=None):
    """Unpenalised logistic regression with an intercept."""
    z, b = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    w = np.ones(len(x)) if w is None else w
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b += np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + 1e-12 * np.eye(len(b)), z.T @ (w * (y - p)))
    return lambda t: 1 / (1 + np.exp(-np.c_[np.ones(len(t)), t] @ b))


def patients(spark, n=45, d=2, seed=5):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    x = rng.normal(size=(n, d)) * [1.0, 30.0][:d] + 0.4 * y[:, None]
    rows = [(f"s{i:02d}", x[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, embedding array<double>, label int"), rows


def folds_of(rows, k, seed=0):
    h = lambda i: hashlib.md5(f"{i}:{seed}".encode()).hexdigest()
    return {r[0]: n % k for n, r in enumerate(sorted(rows, key=lambda r: (r[2], h(r[0]), r[0])))}, h


def xy(rows):
    return np.asarray([r[1] for r in rows]), np.asarray([r[2] for r in rows])


def test_fitted_scores(spark):
    df, rows = patients(spark)
    got = {(r["role"], r["sample_id"]): r for r in K.fit_score(df.where("sample_id < 's30'"), df.where("sample_id >= 's30'"), "logistic_regression").collect()}
    f = newton(*xy(rows[:30]))
    want = f(xy(rows)[0])
    for i, r in enumerate(rows):
        g = got[("train" if i < 30 else "test", r[0])]
        assert g["pred_score"] == pytest.approx(want[i], abs=2e-3) and g["label"] == r[2] and (abs(want[i] - 0.5) < 0.01 or g["pred"] == (want[i] > 0.5))
    assert len(got) == 45


def test_kernel_separates_rings(spark):
    rng = np.random.default_rng(2)
    t = rng.uniform(0, 2 * np.pi, 160)
    rows = [(f"s{i}", [(1 + 2 * (i % 2)) * math.cos(a), (1 + 2 * (i % 2)) * math.sin(a)], i % 2) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "sample_id string, embedding array<double>, label int")
    right = lambda p: one(K.fit_score(df, df, "svc", p).where("role = 'test'").agg(F.avg((F.col("label") == F.col("pred")).cast("double"))))
    assert right(None) > 0.97 and right({"kernel": "linear"}) < 0.75
    x = np.asarray([r[1] for r in rows])
    assert K.scale_gamma(df) == pytest.approx(1 / (2 * x.var()))
    z = {r["sample_id"]: np.asarray(r["embedding"]) for r in K.fourier_features(df, 0.3, 8192).collect()}
    assert all(abs(z["s0"] @ z[f"s{i}"] - math.exp(-0.3 * ((x[0] - x[i]) ** 2).sum())) < 0.05 for i in range(0, 160, 7))


def test_unknown_names_are_forests():
    assert type(K.make_classifier("no such name")).__name__ == type(K.make_classifier("randomforest")).__name__ == "RandomForestClassifier"


def test_cross_validation(spark):
    df, rows = patients(spark, n=30)
    rng = np.random.default_rng(1)
    cells = [(f"{r[0]}-{j}", r[0], (np.asarray(r[1]) + rng.normal(size=2)).tolist()) for r in rows for j in range(4)]
    emb = spark.createDataFrame([(c, v) for c, _, v in cells], "cell_id string, embedding array<double>")
    owner = spark.createDataFrame([(c, s) for c, s, _ in cells], "cell_id string, sample_id string")
    roles = P.kfold_roles(P.stratified_kfold(df.drop("embedding"), 3, 0))
    got = {(r["strategy"], r["fold"], r["role"], r["sample_id"]): r["pred_score"] for r in K.cross_validate(emb, owner, roles, "logistic_regression").collect()}
    fold, _ = folds_of(rows, 3)
    y = {r[0]: r[2] for r in rows}
    mean = {s: np.mean([v for _, o, v in cells if o == s], axis=0) for s in y}
    assert len(got) == 2 * 3 * 30
    for k in range(3):
        train = [s for s in y if fold[s] != k]
        f = newton(np.asarray([mean[s] for s in train]), np.asarray([y[s] for s in train]))
        g = newton(np.asarray([v for _, o, v in cells if fold[o] != k]), np.asarray([y[o] for _, o, _ in cells if fold[o] != k]))
        for s in y:
            role = "test" if fold[s] == k else "train"
            assert got[("avg", k, role, s)] == pytest.approx(f(mean[s][None])[0], abs=3e-3)
            each = g(np.asarray([v for _, o, v in cells if o == s]))
            assert got[("vote", k, role, s)] == pytest.approx(each.mean(), abs=3e-3)


def test_learning_curve(spark):
    df, rows = patients(spark)
    fold, h = folds_of(rows, 3)
    for r in K.learning_curve(df, [20, 28], 3).collect():
        loss = []
        for k in range(3):
            train = sorted((x for x in rows if fold[x[0]] != k), key=lambda x: (h(x[0]), x[0]))[: r["size"]]
            x, y = xy([x for x in rows if fold[x[0]] == k])
            p = newton(*xy(train))(x)
            loss.append(float(np.mean(-np.log(np.where(y == 1, p, 1 - p)))))
        assert r["mean"] == pytest.approx(np.mean(loss), abs=3e-3) and r["sd"] == pytest.approx(np.std(loss, ddof=1), abs=3e-3)


@pytest.mark.parametrize("k", [3, None])
def test_baseline(spark, k):
    """Medians, deviations and class weights of the training side alone; k None leaves one row out at a time."""
    df, rows = patients(spark, n=45 if k else 15)
    rows[4][1][0] = rows[9][1][1] = None
    df = spark.createDataFrame(rows, df.schema)
    fold, _ = folds_of(rows, k or len(rows))
    got = {r["sample_id"]: r for r in K.baseline_oof(df, k).collect()}
    assert len(got) == len(rows)
    for f in set(fold.values()):
        side = lambda keep: ([r for r in rows if (fold[r[0]] == f) != keep])  # noqa: B023, E731
        (x, y), (t, _) = [(np.asarray([r[1] for r in s], dtype=float), np.asarray([r[2] for r in s])) for s in (side(True), side(False))]
        mid = [sorted(c[~np.isnan(c)])[(len(c[~np.isnan(c)]) - 1) // 2] for c in x.T]
        x, t = np.where(np.isnan(x), mid, x), np.where(np.isnan(t), mid, t)
        m, s = x.mean(0), x.std(0, ddof=1)
        p = newton((x - m) / s, y, np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum()))((t - m) / s)
        for r, v in zip(side(False), p, strict=True):
            assert got[r[0]]["pred_score"] == pytest.approx(v, abs=3e-3) and got[r[0]]["fold"] == f


def test_one_against_the_rest(spark):
    rows = [("a", [0.7, 0.2, 0.1]), ("a", [0.4, 0.5, 0.1]), ("b", [0.5, 0.4, 0.1]), ("b", [0.1, 0.8, 0.1]), ("c", [0.3, 0.3, 0.4]), (None, [0.2, 0.2, 0.6])]
    df = spark.createDataFrame(rows, "label string, pred_scores array<double>")
    auc = []
    for k, c in enumerate("abc"):
        pos, neg = [s[k] for y, s in rows if y == c], [s[k] for y, s in rows if y != c]
        auc.append(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
    assert one(K.roc_auc(df, classes=["a", "b", "c"])) == pytest.approx(np.mean(auc))
    assert one(K.roc_auc(df, classes=["a", "b", "c", "d"])) is None and one(K.average_precision(df.where("label = 'a'"), classes=["a", "b"])) is None


# --- tails ---


def test_t_tails(spark):
    g = spark.createDataFrame([("a", x) for x in (1.0, 2.5, 3.0, 4.5)] + [("b", x) for x in (3.0, 4.0, 6.5)], "m string, v double")
    r = R.with_p(R.pairwise_ttest(g, "m", "v")).first()
    t = np.linspace(0, abs(r["t"]), 400_001)
    f = math.gamma((r["df"] + 1) / 2) / (math.sqrt(r["df"] * math.pi) * math.gamma(r["df"] / 2)) * (1 + t * t / r["df"]) ** (-(r["df"] + 1) / 2)
    assert r["df"] == 5 and r["p"] == pytest.approx(1 - 2 * float(np.trapezoid(f, t)), abs=1e-8)


@pytest.mark.parametrize("d", [[1.0, -2.0, 3.0, 4.0, -5.0, 6.0, 7.0], [3.0, 1.0, -2.0, 8.0, 9.0]])
def test_signed_ranks_by_all_signs(spark, d):
    r = R.wilcoxon_pairs(spark.createDataFrame([("m", x, 0.0) for x in d], "g string, x double, y double"), ["g"]).first()
    order = {x: i + 1 for i, x in enumerate(sorted(map(abs, d)))}
    low = lambda s: min(sum(order[abs(x)] for x, k in zip(d, s, strict=True) if k), sum(order[abs(x)] for x, k in zip(d, s, strict=True) if not k))
    w = low([x > 0 for x in d])
    share = np.mean([low(s) <= w for s in itertools.product([0, 1], repeat=len(d))])
    assert r["w"] == w and r["p"] == pytest.approx(share)


def plain_loess(x, y, span):
    """Every point's own weighted least squares, all distances sorted."""
    q, out = max(3, int(span * len(x) + 1e-5)), []
    for p in x:
        d = np.abs(x - p)
        h = np.sort(d)[q - 1]
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        a = np.stack([np.ones(len(x)), x - p, (x - p) ** 2], 1)
        out.append(np.linalg.solve((a * w[:, None]).T @ a, (a * w[:, None]).T @ y)[0])
    return np.asarray(out)


@pytest.mark.parametrize("block", [512, 7])
def test_local_trend_is_a_plain_loess(spark, block):
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=150), [0.5, 0.5, 0.5, 9.0]]
    y = np.sin(x) + rng.normal(size=len(x)) / 10
    points = spark.createDataFrame([(f"g{i}", float(a), float(b), i) for i, (a, b) in enumerate(zip(x, y))], "gene_id string, x double, y double, extra int").repartition(3)
    for span in (0.3, 0.8):
        got = {r["gene_id"]: r["trend"] for r in V.local_trend(points, span, block).collect()}
        assert np.allclose([got[f"g{i}"] for i in range(len(x))], plain_loess(x, y, span), atol=1e-6)
    assert V.local_trend(points.where("false")).collect() == []
    same = V.local_trend(points.withColumn("x", F.lit(2.0)), 0.3, block).collect()
    assert np.allclose([r["trend"] for r in same], y.mean())


def test_variable_genes_of_counts_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.poisson(rng.gamma(1, 2, (1, 80)) * rng.gamma(2, 0.5, (60, 80)))
    i, j = np.nonzero(x)
    expr = spark.createDataFrame([(f"c{a}", f"g{b:02d}", float(x[a, b])) for a, b in zip(i.tolist(), j.tolist())], "cell_id string, gene_id string, value double")
    mean, var = x.mean(0), x.var(0, ddof=1)
    ok = var > 0
    sd = np.full(80, np.nan)
    sd[ok] = np.sqrt(10 ** plain_loess(np.log10(mean[ok]), np.log10(var[ok]), 0.3))
    z = np.minimum((x - mean) / sd, np.sqrt(60))
    norm = (z**2).sum(0) / 59
    want = sorted(((round(norm[b], 6), f"g{b:02d}") for b in np.flatnonzero(ok)), key=lambda t: (-t[0], t[1]))[:20]
    got = [(round(r["norm_var"], 6), r["gene_id"]) for r in V.hvg_v3(expr, 60, 20).collect()]
    assert [g for _, g in got] == [g for _, g in want] and np.allclose([v for v, _ in got], [v for v, _ in want], atol=1e-5)


def test_samples_shuffle_what_they_keep(spark, monkeypatch):
    """The same rows as a full sort by hash, though only rows up to the sample's last hash digits are ranked."""
    rows = [(f"c{i}", None if i % 50 == 0 else "abcd"[min(i % 7, 3)]) for i in range(1200)]
    df = spark.createDataFrame(rows, "cell_id string, g string").repartition(3)
    seen, ranked = [], P.ranked
    monkeypatch.setattr(P, "ranked", lambda x, *a: (seen.append(x.count()), ranked(x, *a))[1])
    got = {(r["run"], r["g"], r["cell_id"]) for r in P.bootstrap_samples(df.where("g is not null"), 3, 40, "g", 11).collect()}
    want = set()
    sizes = Counter(g for _, g in rows if g)
    for run in range(3):
        share = {g: round(40 * n / sum(sizes.values()), 9) for g, n in sizes.items()}
        quota = {g: int(x) for g, x in share.items()}
        for g in sorted(share, key=lambda g: (-round(share[g] - int(share[g]), 9), g))[: 40 - sum(quota.values())]:
            quota[g] += 1
        for g, q in quota.items():
            own = sorted((hashlib.md5(f"{c}:{run + 11}".encode()).hexdigest(), c) for c, x in rows if x == g)
            want |= {(run, g, c) for _, c in own[:q]}
    assert got == want and len(got) == 120 and seen[0] <= 130
    assert P.sample_stratified(df.where("g is not null"), 5000, "g", 1).count() == sum(sizes.values())


def test_score_curves_by_ranges_with_ties_and_hot_runs(spark):
    """Areas by counting pairs; every run over several ranges."""
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else None, int(rng.integers(0, 2)), float(rng.integers(0, 40)) / 40) for i in range(600)]
    df = spark.createDataFrame(rows, "run string, label int, pred_score double").repartition(5)
    got = {r["run"]: r["roc_auc"] for r in K.roc_auc(df, ["run"]).collect()}
    points = K.roc_points(df, ["run"]).collect()
    for run in ("hot", None):
        one, zero = ([s for r, l, s in rows if r == run and l == x] for x in (1, 0))
        assert abs(got[run] - sum((a > b) + (a == b) / 2 for a in one for b in zero) / len(one) / len(zero)) < 1e-12
        for p in (p for p in points if p["run"] == run):
            assert abs(p["tpr"] - sum(s >= p["pred_score"] for s in one) / len(one)) < 1e-12 and abs(p["fpr"] - sum(s >= p["pred_score"] for s in zero) / len(zero)) < 1e-12
    assert len(points) == len({(r, s) for r, _, s in rows})


def test_a_null_group_is_a_group(spark):
    """Neighbours and silhouettes within keys: nulls are equal, no row vanishes."""
    df, rows = table(spark, n=40)
    some = df.withColumn("label", F.when(F.col("label") != "L1", F.col("label")))
    named = df.withColumn("label", F.when(F.col("label") != "L1", F.col("label")).otherwise("none"))
    a, b = (N.knn(x, 4, within=["label"]).select(F.coalesce("label", F.lit("none")), "i", "j", "rank", "distance") for x in (some, named))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.select("i").distinct().count() == len(rows)
    assert M.batch_asw(some).first()["batch_asw"] == pytest.approx(M.batch_asw(named).first()["batch_asw"])


def test_benchmark_fits_an_embeddings_clusters_once(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    from skarn.operators import embed_metrics as M

    fits, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    monkeypatch.setattr(M, "embedding_suite", lambda *a, **k: spark.createDataFrame([], "key string, metric string, value double, error string"))
    emb = spark.createDataFrame([("e", f"c{i}", [float(10 * (i % 2)), i / 100], f"B{i // 2 % 2}", f"L{i % 2}") for i in range(24)], "key string, cell_id string, embedding array<double>, batch string, label string")
    got = {r["metric"]: (r["value"], r["error"]) for r in M.benchmark(emb).collect()}
    assert len(fits) == 1 and all(got[m][1] is None and abs(got[m][0] - 1) < 1e-9 for m in ("nmi_kmeans", "ari_kmeans"))
