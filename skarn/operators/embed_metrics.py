"""Quality of embeddings: clustering agreement, silhouettes, mixing of batches."""

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import chi2_sf
from ..plans.storage import written
from . import features, graph, splits
from .quantiles import quantiles


def _contingency(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))


def nmi(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Normalised mutual information, arithmetic mean; 1 where both are constant."""
    by = by or []
    t = _contingency(df, a, b, by)
    w = Window.partitionBy(*by)
    t = t.withColumn("total", F.sum("n").over(w)).withColumn("na", F.sum("n").over(Window.partitionBy(*by, "a"))).withColumn("nb", F.sum("n").over(Window.partitionBy(*by, "b")))
    p = F.col("n") / F.col("total")
    s = t.groupBy(*by).agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("i"), F.sum(-p * F.log(F.col("na") / F.col("total"))).alias("ha"), F.sum(-p * F.log(F.col("nb") / F.col("total"))).alias("hb"))
    return s.select(*by, F.when(F.col("ha") + F.col("hb") < 1e-12, 1.0).otherwise(2 * F.col("i") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def ari(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    t = _contingency(df, a, b, by)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    one = lambda k: t.groupBy(*by, k).agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs("n").alias(f"p{k}"))
    s = t.groupBy(*by).agg(pairs("n").alias("s"), F.sum("n").alias("n"))
    s = (s.join(one("a"), by).join(one("b"), by)) if by else s.crossJoin(one("a")).crossJoin(one("b"))
    e = F.try_divide(F.col("pa") * F.col("pb"), F.col("n") * (F.col("n") - 1) / 2)
    top = 0.5 * (F.col("pa") + F.col("pb")) - e
    return s.select(*by, F.when(F.abs(top) < 1e-12, 1.0).otherwise((F.col("s") - e) / top).alias("ari"))


def _distance_slices(x: np.ndarray, y: np.ndarray):
    """(p, q, distances) of slices of x from p and of y from q, euclidean, that stay in a core's cache."""
    xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    for p in range(0, len(x), 256):
        for q in range(0, len(y), 2048):
            d = 2 * x[p : p + 256] @ y[q : q + 2048].T
            np.subtract(xx[p : p + 256, None] + yy[q : q + 2048], d, out=d)
            yield p, q, np.sqrt(np.maximum(d, 0, out=d), out=d)


def _distance_sums(x: np.ndarray, y: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Sums of the euclidean distances of each of x to the rows of y by their category's number (m of them)."""
    sums, one = np.zeros((len(x), m)), (at[:, None] == np.arange(m)).astype(float)
    for p, q, d in _distance_slices(x, y):
        sums[p : p + 256] += d @ one[q : q + 2048]
    return sums


def _distance_runs(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the euclidean distances of each of x to the runs of y that begin at starts, the first at 0."""
    sums = np.zeros((len(x), len(starts)))
    for p, q, d in _distance_slices(x, y):
        lo, hi = np.searchsorted(starts, q, "right") - 1, np.searchsorted(starts, q + d.shape[1])
        sums[p : p + 256, lo:hi] += np.add.reduceat(d, np.maximum(starts[lo:hi] - q, 0), axis=1)
    return sums


def _distance_both(x: np.ndarray, y: np.ndarray, x_starts: np.ndarray, y_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, and the sums of each of y to the runs of x that begin at x_starts: every distance is computed once."""
    sums, back = np.zeros((len(x), len(y_starts))), np.zeros((len(x_starts), len(y)))
    for p, q, d in _distance_slices(x, y):
        lo, hi = np.searchsorted(y_starts, q, "right") - 1, np.searchsorted(y_starts, q + d.shape[1])
        sums[p : p + 256, lo:hi] += np.add.reduceat(d, np.maximum(y_starts[lo:hi] - q, 0), axis=1)
        lo, hi = np.searchsorted(x_starts, p, "right") - 1, np.searchsorted(x_starts, p + d.shape[0])
        back[lo:hi, q : q + 2048] += np.add.reduceat(d, np.maximum(x_starts[lo:hi] - p, 0), axis=0)
    return sums, back.T


def silhouette_samples(emb: DataFrame, cat: str, within: list[str] | None = None, block_rows: int | None = None) -> DataFrame:
    """(within, i, cat, s) by euclidean distances: tasks emit distance sums by cell and category, never distances."""
    keys = within or []
    total = _distance_sums  # goes with the job

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ia, x, ca = graph._vectors(b.column(len(keys))[r])
                _, y, cb = graph._vectors(b.column(len(keys) + 1)[r])
                names, at = np.unique(cb.astype(str), return_inverse=True)
                sums = total(x, y, at, len(names))
                n, m = sums.shape
                cols = [pa.array([b.column(c)[r].as_py()] * (n * m), b.column(c).type) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.repeat(ia, m)), pa.array(np.repeat(ca, m)), pa.array(np.tile(names.astype(object), n)), pa.array(sums.ravel()), pa.array(np.tile(np.bincount(at), n))], names=[*keys, "i", "own", "other", "d", "n"])

    e = emb.withColumn("cat", F.col(cat).cast("string"))
    schema = "".join(f"`{c}` {emb.schema[c].dataType.simpleString()}, " for c in keys) + "i string, own string, other string, d double, n long"
    t = graph.block_pairs(e, e, within, block_rows).mapInArrow(run, schema).groupBy(*keys, "i", "own", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    return _silhouettes(t, keys)


def _silhouettes(t: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of distances (keys, i, own, other, d, n) -> (keys, i, cat, s)."""
    mine = F.col("own") == F.col("other")
    s = t.groupBy(*keys, "i", "own").agg(F.max(F.when(mine, F.when(F.col("n") > 1, F.col("d") / (F.col("n") - 1)))).alias("a"), F.min(F.when(~mine, F.col("d") / F.col("n"))).alias("b"))
    v = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return s.select(*keys, "i", F.col("own").alias("cat"), F.coalesce(v, F.lit(0.0)).alias("s"))


def distance_sums(emb: DataFrame, batch: str = "batch", label: str = "label", by: list[str] | None = None, block_rows: int | None = None) -> DataFrame:
    """(by, kind, i, label, own, other, d, n): sums of each cell's distances to all of its group by label (kind "label") and by batch ("batch"), and to those of its label by batch ("within", the only kind with a label).
    Every distance is computed once for the three, and for both its ends where blocks differ."""
    keys = by or []
    total, twice = _distance_runs, _distance_both  # go with the job

    def sided(s):
        """A block in the order of its categories: vectors, ids, labels, batches, the labels' and batches' names, and by runs of both: number of label and batch, start, rows."""
        x, l, c = s.field("embedding").flatten().to_numpy().reshape(len(s), -1), *(s.field("cat").field(f) for f in ("l", "b"))
        (ln, lc), (bn, bc) = ((e.dictionary, e.indices.to_numpy()) for e in (v.dictionary_encode(null_encoding="encode") for v in (l, c)))
        order = np.lexsort((bc, lc))
        lc, bc, at = lc[order], bc[order], pa.array(order)
        starts = np.flatnonzero((np.diff(lc, prepend=-1) != 0) | (np.diff(bc, prepend=-1) != 0))
        return x[order], s.field("cell_id").take(at), l.take(at), c.take(at), ln, bn, lc[starts], bc[starts], starts, np.diff(starts, append=len(lc))

    def told(own, other, sums, group):
        _, ids, la, ba, *_ = own
        *_, ln, bn, l_of, b_of, _, n = other
        own_l = {v: i for i, v in enumerate(ln.to_pylist())}
        mine = np.array([own_l.get(v, -1) for v in la.to_pylist()])
        every = np.arange(len(ids))
        parts = [("label", None, la, ln, (l_of[:, None] == np.arange(len(ln))).astype(float), every), ("batch", None, ba, bn, (b_of[:, None] == np.arange(len(bn))).astype(float), every)]
        for l in range(len(ln)):
            rows = np.flatnonzero(mine == l)
            if len(rows):
                parts.append(("within", ln[l].as_py(), ba, bn, ((b_of[:, None] == np.arange(len(bn))) & (l_of == l)[:, None]).astype(float), rows))
        for kind, of, cat, names, one, rows in parts:
            count = n @ one
            at = np.flatnonzero(count)
            names = pa.array([str(v) for v in names.to_pylist()], pa.string())
            i, j = pa.array(np.repeat(rows, len(at))), pa.array(np.tile(at, len(rows)))
            size = len(i)
            cols = [pa.array([v] * size, t) for v, t in group]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([kind] * size), ids.take(i), pa.array([of] * size, pa.string()), cat.take(i), names.take(j), pa.array((sums[rows] @ one[:, at]).ravel()), pa.array(np.tile(count[at].astype("i8"), len(rows)))], names=[*keys, "kind", "i", "label", "own", "other", "d", "n"])

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                group = [(b.column(c)[r].as_py(), b.column(c).type) for c in range(len(keys))]
                a, o = (sided(b.column(len(keys) + k)[r].values) for k in range(2))
                if b.column(len(keys) + 2)[r] == b.column(len(keys) + 3)[r]:  # a block and itself
                    yield from told(a, o, total(a[0], o[0], o[-2]), group)
                    continue
                sums, back = twice(a[0], o[0], a[-2], o[-2])
                yield from told(a, o, sums, group)
                yield from told(o, a, back, group)

    e = emb.select(*keys, "cell_id", "embedding", F.struct(F.col(label).cast("string").alias("l"), F.col(batch).cast("string").alias("b")).alias("cat"))
    schema = "".join(f"`{c}` {emb.schema[c].dataType.simpleString()}, " for c in keys) + "kind string, i string, label string, own string, other string, d double, n long"
    t = graph.once(graph.block_pairs(e, e, keys, block_rows)).mapInArrow(run, schema)
    return t.groupBy(*keys, "kind", "i", "label", "own", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))


def silhouette(emb: DataFrame, cat: str, rescale: bool = True, by: list[str] | None = None) -> DataFrame:
    return _mean_silhouette(silhouette_samples(emb, cat, by), by, rescale)


def _mean_silhouette(samples: DataFrame, by: list[str] | None, rescale: bool = True) -> DataFrame:
    m = F.avg("s")
    return samples.groupBy(*(by or [])).agg(((m + 1) / 2 if rescale else m).alias("silhouette"))


def batch_asw(emb: DataFrame, batch: str = "batch", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """1 - |s| of batches inside each label, mean over cells, then over labels that have several batches."""
    by = by or []
    return _mean_asw(silhouette_samples(emb, batch, [*by, label]), label, by)


def _mean_asw(samples: DataFrame, label: str, by: list[str]) -> DataFrame:
    per = samples.groupBy(*by, label).agg(F.avg(1 - F.abs("s")).alias("v"), F.countDistinct("cat").alias("b"), F.count("*").alias("n")).where("b > 1 and b < n")
    return per.groupBy(*by).agg(F.avg("v").alias("batch_asw"))


def graph_connectivity(edges: DataFrame, cells: DataFrame, label: str = "label", by: list[str] | None = None) -> DataFrame:
    by = by or []
    c = graph.components_within(edges, cells, label, by).groupBy(*by, label, "component").count()
    return c.groupBy(*by, label).agg((F.max("count") / F.sum("count")).alias("share")).groupBy(*by).agg(F.avg("share").alias("graph_connectivity"))


def pcr(emb: DataFrame, covariate: str, n_comps: int = 50, by: list[str] | None = None) -> DataFrame:
    """Share of variance that the covariate explains: R2 of each component weighted by its variance. Numbers by correlation, categories by groups.
    by: each group (a run or an embedding, so few) has its own axes and jobs."""
    if by:
        groups = emb.select(*by).distinct().collect()
        same = lambda g: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.lit(g[c])) for c in by])
        one = lambda g: written(pcr(emb.where(same(g)), covariate, n_comps).select(*[F.lit(g[c]).cast(emb.schema[c].dataType).alias(c) for c in by], "pcr"))
        with ThreadPoolExecutor(4) as pool:
            return reduce(DataFrame.unionByName, pool.map(one, groups))
    n = min(n_comps, emb.select(F.size("embedding")).first()[0])
    p, variance = features._project(emb, n, True)
    x = p.select("cell_id", F.col(covariate).alias("c"), F.posexplode("embedding").alias("dim", "v"))
    if dict(emb.dtypes)[covariate] in ("string", "boolean"):
        g = x.groupBy("dim", "c").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
        t = g.groupBy("dim").agg(F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
        r2 = F.try_divide(F.col("B") - F.col("S") * F.col("S") / F.col("N"), F.col("Q") - F.col("S") * F.col("S") / F.col("N"))
    else:
        t = x.groupBy("dim").agg(F.corr("v", "c").alias("r"))
        r2 = F.col("r") * F.col("r")
    w = F.element_at(F.array(*map(F.lit, variance)), F.col("dim") + 1)
    return t.agg(F.try_divide(F.sum(F.greatest(r2, F.lit(0.0)) * w), F.sum(w)).alias("pcr"))


def lisi_samples(edges: DataFrame, cells: DataFrame, cat: str, k: int = 15) -> DataFrame:
    """Inverse Simpson index of each cell's neighbours with weights of perplexity floor(k / 3)."""
    perplexity = max(k // 3, 1)

    def run(batches):
        for b in batches:
            for rows, d in graph._by_length(b, 2):
                def short(beta, d=d):
                    w = np.exp(-(d - d.min(1, keepdims=True)) * beta[:, None])
                    p = w / w.sum(1, keepdims=True)
                    return -(p * np.log(np.maximum(p, 1e-300))).sum(1) - np.log(perplexity)

                beta = graph._bisect(short, np.zeros(len(d)), np.full(len(d), 1e6))
                w = np.exp(-(d - d.min(1, keepdims=True)) * beta[:, None])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(list(w / w.sum(1, keepdims=True)), pa.list_(pa.float64()))], names=["i", "js", "ps"])

    a = graph.neighbors_to_arrays(edges).mapInArrow(run, "i string, js array<string>, ps array<double>")
    x = a.select("i", F.explode(F.arrays_zip("js", "ps")).alias("e")).select("i", F.col("e.js").alias("j"), F.col("e.ps").alias("p"))
    c = x.join(cells.select(F.col("cell_id").alias("j"), F.col(cat).alias("cat")), "j").groupBy("i", "cat").agg(F.sum("p").alias("p"))
    return c.groupBy("i").agg((1 / F.sum(F.col("p") * F.col("p"))).alias("lisi"))


def lisi(edges: DataFrame, cells: DataFrame, cat: str, kind: str, k: int = 15, scale: bool = True, by: list[str] | None = None) -> DataFrame:
    """Median index; scaled so that 1 is best: batches well mixed ('i'), labels kept apart ('c'). Null where there is one category."""
    by = by or []
    x = lisi_samples(edges, cells, cat, k)
    x = x.join(cells.select(F.col("cell_id").alias("i"), *by), "i") if by else x
    m, n = quantiles(x, "lisi", [0.5], by).select(*by, F.col("quantiles")[0].alias("m")), cells.groupBy(*by).agg(F.countDistinct(cat).alias("n"))
    v = F.col("m") if not scale else F.try_divide(F.col("m") - 1 if kind == "i" else F.col("n") - F.col("m"), F.col("n") - 1)
    return (m.join(n, by) if by else m.crossJoin(n)).select(*by, v.alias(f"{kind}lisi"))


def kbet_statistic(emb: DataFrame, batch: str = "batch", label: str = "label", k: int = 15, by: list[str] | None = None, diffused: bool = False) -> DataFrame:
    """(by, label, i, chi2, df) of neighbour batches inside the label against the label's shares.

    diffused: of each label's neighbour graph the largest component (ties: that of the smallest cell), and in it the k - 1 others that random walks reach most; ids are unique over `by`."""
    keys = [*(by or []), label]
    e = graph.knn(emb, k, "cosine", within=keys)
    if diffused:
        w = written(graph.connectivities(e, k))
        comp = graph.components(w, emb).join(emb.select("cell_id", *keys), "cell_id")
        size = comp.groupBy(*keys, "component").agg(F.count("*").alias("__n"), F.min("cell_id").alias("__first"))
        largest = size.groupBy(*keys).agg(F.min_by("component", F.struct(-F.col("__n"), "__first")).alias("component"))
        kept = written(comp.join(largest.select("component"), "component", "left_semi").drop("component"))
        e = graph.diffusion_neighbors(w.join(kept.select(F.col("cell_id").alias("i")), "i", "left_semi"), k - 1).join(kept.withColumnRenamed("cell_id", "i"), "i")
        emb = emb.join(kept.select("cell_id"), "cell_id", "left_semi")
    obs = e.join(emb.select(F.col("cell_id").alias("j"), F.col(batch).alias("b")), "j").groupBy(*keys, "i", "b").agg(F.count("*").alias("o"))
    share = emb.groupBy(*keys, F.col(batch).alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)  # a row per label and batch
    share = share.withColumn("f", F.col("n") / F.sum("n").over(w)).withColumn("n_batches", F.count("*").over(w)).where("n_batches > 1")
    size = e.groupBy(*keys, "i").agg(F.count("*").alias("k"))
    x = size.join(share, keys).join(obs, [*keys, "i", "b"], "left")
    want = F.col("k") * F.col("f")
    return x.groupBy(*keys, "i").agg(F.sum(F.pow(F.coalesce("o", F.lit(0)) - want, 2) / want).alias("chi2"), (F.max("n_batches") - 1).alias("df"))


def kbet_per_label(emb: DataFrame, batch: str = "batch", label: str = "label", k: int = 15, alpha: float = 0.05, by: list[str] | None = None, diffused: bool = False) -> DataFrame:
    by = by or []
    s = kbet_statistic(emb, batch, label, k, by, diffused).withColumn("p", chi2_sf("chi2", F.col("df").cast("double")))
    return s.groupBy(*by, label).agg(F.avg((F.col("p") >= alpha).cast("double")).alias("accepted")).groupBy(*by).agg(F.avg("accepted").alias("kbet"))


def knn_purity(edges: DataFrame, cells: DataFrame, cat: str, by: list[str] | None = None) -> DataFrame:
    """Mean share of neighbours of the same category; cells without neighbours are left out."""
    by = by or []
    a, b = cells.select(*by, F.col("cell_id").alias("i"), F.col(cat).alias("x")), cells.select(F.col("cell_id").alias("j"), F.col(cat).alias("y"))
    s = edges.select("i", "j").join(a, "i").join(b, "j").groupBy(*by, "i").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("s"))
    return s.groupBy(*by).agg(F.avg("s").alias("purity"))


def knn_predictions(emb: DataFrame, label: str = "label", k: int = 15, test: float = 0.2, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    by = by or []
    roles = splits.train_test_split(emb.withColumn("__s", F.struct(*by, label)) if by else emb, test, seed, "cell_id", "__s" if by else label)
    roles = written(roles.drop("__s"))
    train, held = roles.where("role = 'train'"), roles.where("role = 'test'")
    return graph.knn_classify(train, held, k, label, within=by).join(held.select("cell_id", *by, F.col(label).alias("label")), "cell_id")


def knn_label_scores(emb: DataFrame, label: str = "label", k: int = 15, test: float = 0.2, seed: int = 0) -> DataFrame:
    from .classify import macro_scores

    return macro_scores(knn_predictions(emb, label, k, test, seed))


def batch_pred_acc(emb: DataFrame, batch: str = "batch", k: int = 15, test: float = 0.2, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """Accuracy of batches from neighbours; null with one batch."""
    by = by or []
    p = knn_predictions(emb, batch, k, test, seed, by)
    return p.groupBy(*by).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("acc"), F.countDistinct("label").alias("n")).select(*by, F.when(F.col("n") > 1, F.col("acc")).alias("batch_pred_acc"))


def avg_bio(nmi_df: DataFrame, ari_df: DataFrame, asw_df: DataFrame) -> DataFrame:
    return nmi_df.crossJoin(ari_df).crossJoin(asw_df).select(((F.col("nmi") + F.col("ari") + F.col("silhouette")) / 3).alias("avg_bio"))  # one row each


def _apart(emb: DataFrame, by: list[str]) -> DataFrame:
    """Ids made unique over groups, so that every later join needs the id alone."""
    return emb.withColumn("cell_id", F.concat_ws("\u0001", *[F.col(c).cast("string") for c in by], "cell_id")) if by else emb


def _reported(jobs: dict, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, metric, value, error) of independent metrics. One that fails is a row without value for each group, with its error; no number, no row."""

    def one(job):
        name, f = job
        try:
            x = f().toDF(*by, "value").select(*by, F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("error"))
            return written(x.where("value is not null and not isnan(value)"))
        except Exception as e:  # noqa: BLE001 - reported as a row
            return groups.select(*by, F.lit(name).alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(f"{type(e).__name__}: {str(e).strip().splitlines()[0] if str(e).strip() else ''}").alias("error"))

    with ThreadPoolExecutor(4) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, jobs.items()))


def embedding_suite(emb: DataFrame, batch: str = "batch", label: str = "label", k: int = 15, clusters: DataFrame | None = None, by: list[str] | None = None, more=None) -> DataFrame:
    """(by, metric, value, error): all metrics of each group of `by` (runs, embeddings), none for one table.

    Batch metrics only for groups with several batches. A metric that fails gives a row with its error and no value, one that is no number gives none.
    clusters(by, cell_id, community): communities of the neighbour graph unless given. more: further metrics by name, functions of the labels' silhouettes (by, i, cat, s)."""
    by = by or []
    emb = written(_apart(emb.select(*by, "cell_id", "embedding", batch, label), by))
    groups = written(emb.groupBy(*by).agg(F.countDistinct(batch).alias("__b")))  # a row per group
    cells = emb.drop("embedding")
    edges = written(graph.knn(emb, k, within=by))

    def clustered():
        if clusters is not None:
            found = _apart(clusters, by).select("cell_id", "community")
        else:
            ids = emb.select(F.col("cell_id").alias("i"), F.concat_ws("\u0001", F.lit(""), *[F.col(c).cast("string") for c in by]).alias("g"))
            found = graph.communities(graph.connectivities(edges, k), 0.3, groups=ids)
        return written(cells.join(found, "cell_id"))

    several = groups.where("__b > 1").drop("__b")
    some = (lambda df: df.join(F.broadcast(several), by, "left_semi")) if by else (lambda df: df)  # a row per group
    mixed, mixed_cells, mixed_edges = some(emb), some(cells), some(edges)
    def separation(kind, keys=by):
        return _silhouettes(sums.result().where(F.col("kind") == kind), keys)

    def agreement(score):
        return score(joined.result(), "community", label, by)  # one that failed is reported by both scores

    jobs = {"graph_connectivity": lambda: graph_connectivity(edges, cells, label, by), "purity_label": lambda: knn_purity(edges, cells, label, by), "clisi": lambda: lisi(edges, cells, label, "c", k, by=by)}
    if not groups.where("__b > 1").isEmpty():
        jobs |= {"ilisi": lambda: lisi(mixed_edges, mixed_cells, batch, "i", k, by=by), "kbet": lambda: kbet_per_label(mixed, batch, label, k, by=by), "pcr": lambda: pcr(mixed, batch, by=by), "batch_pred_acc": lambda: batch_pred_acc(mixed, batch, k, by=by),
                 "purity_batch": lambda: knn_purity(mixed_edges, mixed_cells, batch, by), "asw_batch": lambda: _mean_silhouette(some(separation("batch")), by), "batch_asw": lambda: _mean_asw(some(separation("within", [*by, "label"])), "label", by)}
    jobs |= {"asw_label": lambda: _mean_silhouette(separation("label"), by), "nmi": lambda: agreement(nmi), "ari": lambda: agreement(ari)}  # those that wait come last
    jobs |= {name: lambda f=f: f(separation("label")) for name, f in (more or {}).items()}
    with ThreadPoolExecutor(2) as beside:  # communities are found in many small jobs, beside all that doesn't need them
        sums, joined = beside.submit(lambda: written(distance_sums(emb, batch, label, by))), beside.submit(clustered)
        return _reported(jobs, groups, by)


def bootstrap_suite(emb: DataFrame, n_runs: int, n: int, by: str, seed: int, k: int = 15, batch: str = "batch", label: str = "label") -> DataFrame:
    """(run, metric, value, error): the whole suite of each run, the run being a key of every aggregate; failures are rows."""
    return embedding_suite(splits.bootstrap_samples(emb, n_runs, n, by, seed), batch, label, k, by=["run"])


def bootstrap_summary(runs: DataFrame) -> DataFrame:
    """Each metric over the runs that have it: their number, mean, deviation and median, and how many runs failed."""
    return runs.groupBy("metric").agg(F.count("value").alias("n_runs"), F.count("error").alias("n_failed"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"))


def benchmark(emb: DataFrame, batch: str = "batch", label: str = "label", seed: int = 1, key: str = "key") -> DataFrame:
    """emb(key, cell_id, embedding, batch, label), one or several embeddings by key -> key, metric, value, error: the suite, agreement of k-means clusters
    (as many as labels) and the silhouette of the labels found in the fewest batches. Embeddings may differ in length and cells."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    by = [key]
    emb = written(emb.select(key, "cell_id", "embedding", batch, label))
    keys = sorted(r[0] for r in emb.select(key).distinct().collect())  # embeddings: few

    def clusters(name):
        v = emb.where(F.col(key) == name).withColumn("v", array_to_vector("embedding"))
        model = KMeans(k=max(v.select(label).distinct().count(), 2), seed=seed, featuresCol="v", predictionCol="community").fit(v)
        return written(model.transform(v).select(key, "cell_id", label, F.col("community").cast("string").alias("community")))

    try:
        found = reduce(DataFrame.unionByName, map(clusters, keys))
    except Exception as e:  # noqa: BLE001 - both scores that need it report it
        found = e

    def kmeans(score):
        if isinstance(found, Exception):
            raise found
        return score(found, "community", label, by)

    def isolated(samples):
        few = emb.groupBy(key, F.col(label).alias("cat")).agg(F.countDistinct(batch).alias("b"))
        few = few.withColumn("least", F.min("b").over(Window.partitionBy(key))).where("b = least").select(key, F.col("cat").cast("string").alias("cat"))  # a row per label
        return samples.join(few, [key, "cat"]).groupBy(key).agg((F.avg("s") + 1) / 2)

    more = _reported({"nmi_kmeans": lambda: kmeans(nmi), "ari_kmeans": lambda: kmeans(ari)}, emb.select(key).distinct(), by)
    return embedding_suite(emb, batch, label, by=by, more={"isolated_label_asw": isolated}).unionByName(more)
