"""Variable genes, projections and embeddings."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import l2, uniform, vector_stat
from ..plans.storage import written
from . import axes
from .qc import gene_moments, log1p, normalize_total
from .splits import ranked

#: Columns up to which principal axes come from one pass with the whole space as the first block.
EXACT = 512


def _dispersions(moments: DataFrame, by: list[str], n_bins: int) -> DataFrame:
    """moments(gene_id, by, mean, var) -> normalised dispersions: z-scores inside equal-width bins of log1p(mean)."""
    d = moments.withColumn("disp", F.when((F.col("var") > 0) & (F.col("mean") > 0), F.log(F.col("var") / F.col("mean")))).withColumn("m", F.log1p("mean"))
    ends = d.groupBy(*by).agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    d = d.join(ends, by) if by else d.crossJoin(F.broadcast(ends))
    place = F.ceil(F.round((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n_bins, 9))
    d = d.withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.greatest(place, F.lit(1))).otherwise(1))
    s = d.groupBy(*by, "bin").agg(F.avg("disp").alias("avg_bin"), F.stddev_samp("disp").alias("sd_bin"), F.count("disp").alias("n_bin"))
    d = d.join(s, [*by, "bin"])
    one = F.col("n_bin") == 1
    z = F.when(one, F.lit(1.0)).otherwise((F.col("disp") - F.col("avg_bin")) / F.col("sd_bin"))
    return d.withColumn("z", F.when(F.col("disp").isNotNull(), z))


def hvg(expr: DataFrame, n_cells: int, n_top: int, n_bins: int = 20) -> DataFrame:
    """Variable genes of log data: gene_id, mean, disp, z, rank for the n_top largest z, ties by gene."""
    d = _dispersions(gene_moments(expr.withColumn("value", F.expm1("value")), n_cells), [], n_bins)
    best = d.where("z is not null").withColumn("z", F.round("z", 6)).orderBy(F.desc("z"), "gene_id").limit(n_top)
    return best.select("gene_id", "mean", "disp", "z")


def hvg_by_batch(expr: DataFrame, cells: DataFrame, n_top: int, n_bins: int = 20) -> DataFrame:
    """Per batch, then genes by the number of batches that chose them and by mean z."""
    sizes = cells.groupBy("batch").agg(F.count("*").alias("n"))
    x = expr.withColumn("value", F.expm1("value")).join(cells.select("cell_id", "batch"), "cell_id")
    m = x.groupBy("gene_id", "batch").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(sizes, "batch")
    m = m.select("gene_id", "batch", (F.col("s") / F.col("n")).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("var"))
    d = _dispersions(m, ["batch"], n_bins).where("z is not null").withColumn("z", F.round("z", 6))
    rank = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("z"), "gene_id"))
    g = d.withColumn("chosen", rank <= n_top).groupBy("gene_id").agg(F.count_if("chosen").alias("n_batches"), F.round(F.avg("z"), 6).alias("mean_z"))
    return g.orderBy(F.desc("n_batches"), F.desc("mean_z"), "gene_id").limit(n_top)


def hvg_normalized(expr: DataFrame, n_cells: int, n_top: int, target_sum: float = 1e4) -> DataFrame:
    """Chosen on a normalised working copy; returns the counts of the chosen genes untouched."""
    return expr.join(F.broadcast(hvg(log1p(normalize_total(expr, target_sum)), n_cells, n_top)), "gene_id", "left_semi")


def _local_fits(x: np.ndarray, y: np.ndarray, at: np.ndarray, tied: np.ndarray, q: int) -> np.ndarray:
    """Values at `at` of quadratics fitted to the q nearest of the rising x, with tricube weights that reach 0 at the last of them; where that is no farther than the point itself, `tied`."""
    out = tied.copy()
    for i, p in enumerate(at):
        left, right = np.searchsorted(x, p, "left"), np.searchsorted(x, p, "right")
        own = slice(max(0, left - q), min(len(x), right + q))  # the q nearest are among q places to either side
        d = np.abs(x[own] - p)
        h = np.partition(d, q - 1)[q - 1]
        if h == 0:
            continue
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        z, some = (x[own] - p) / h, w > 0
        root = np.sqrt(w[some])
        out[i] = np.linalg.lstsq(root[:, None] * np.stack([np.ones(some.sum()), z[some], z[some] ** 2], 1), root * y[own][some], rcond=None)[0][0]
    return out


def local_trend(points: DataFrame, span: float = 0.3, block: int = 512) -> DataFrame:
    """points(gene_id, x, y) -> with `trend`: at each point the locally weighted quadratic regression of y on x over the floor(span n) nearest points, tricube weights. Where so many lie at the point itself: the mean of all that do.

    Points are numbered by x and dealt to blocks of neighbouring ranks; a block gets the points within floor(span n) ranks of its own, among which all its nearest are, and is fitted in one task."""
    r = ranked(points, [], [F.col("x"), F.col("gene_id")]).withColumn("rank", F.col("__nth") - 1).drop("__nth")
    r = written(r.join(points.groupBy("x").agg(F.avg("y").alias("tied")), "x"))
    n = r.count()
    q = min(n, max(3, int(span * n + 1e-5)))
    own = F.floor(F.col("rank") / block)
    reach = F.sequence(F.greatest(F.floor((F.col("rank") - q) / block), F.lit(0)), F.least(F.floor((F.col("rank") + q) / block), F.lit(max(n - 1, 0) // block)))
    dealt = r.select("gene_id", "x", "y", "tied", F.explode(reach).alias("block"), own.alias("own"))
    fits = _local_fits  # goes with the job

    def run(t: pa.Table) -> pa.Table:
        x, y, tied, mine = (t.column(c).to_numpy() for c in ("x", "y", "tied", "own"))
        order = np.argsort(x, kind="stable")
        here = np.flatnonzero(mine == t.column("block")[0].as_py())
        return pa.table({"gene_id": t.column("gene_id").take(pa.array(here)), "trend": fits(x[order], y[order], x[here], tied[here], min(q, len(x)))})

    return r.select(*points.columns).join(dealt.groupBy("block").applyInArrow(run, "gene_id string, trend double"), "gene_id")


def hvg_v3(expr: DataFrame, n_cells: int, n_top: int, span: float = 0.3) -> DataFrame:
    """Counts: variance standardised by a local quadratic regression of log variance on log mean, clipped at the root of the number of cells."""
    m = gene_moments(expr, n_cells).where("var > 0 and mean > 0").withColumn("x", F.log10("mean")).withColumn("y", F.log10("var"))
    m = local_trend(m, span).withColumn("sd", F.sqrt(F.pow(F.lit(10.0), F.col("trend"))))
    z = F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(float(n_cells) ** 0.5))
    z0 = -F.col("mean") / F.col("sd")
    v = expr.join(m.select("gene_id", "mean", "sd"), "gene_id").groupBy("gene_id").agg(F.sum(z * z).alias("q"), F.count("*").alias("k"), F.first(z0).alias("z0"))
    return v.select("gene_id", ((F.col("q") + (n_cells - F.col("k")) * F.col("z0") * F.col("z0")) / (n_cells - 1)).alias("norm_var")).orderBy(F.desc("norm_var"), "gene_id").limit(n_top)


def hvg_embedding(expr: DataFrame, cells: DataFrame, genes: DataFrame) -> DataFrame:
    """Dense vectors over genes(gene_id) in gene order; zeros where nothing is stored. A cell's stored values are put in their places by arrays."""
    g = genes.select("gene_id").distinct()
    n = g.count()
    place = g.select("gene_id", (F.row_number().over(Window.orderBy("gene_id")) - 1).alias("pos"))  # a row per gene
    v = expr.join(place, "gene_id").groupBy("cell_id").agg(F.collect_list("pos").alias("pos"), F.collect_list(F.col("value").cast("double")).alias("value"))

    lists = axes.lister()

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, max(1, (1 << 22) // max(1, n))):
                some = b.slice(k, max(1, (1 << 22) // max(1, n)))
                x = np.zeros((some.num_rows, n))
                x[np.repeat(np.arange(some.num_rows), pc.list_value_length(some.column(1)).fill_null(0).to_numpy()), some.column(1).flatten().to_numpy()] = some.column(2).flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([some.column(0), lists(x)], names=["cell_id", "embedding"])

    return cells.select(F.col("cell_id").cast("string").alias("cell_id")).join(v, "cell_id", "left").select("cell_id", "pos", "value").mapInArrow(run, "cell_id string, embedding array<double>")


def _sums(v: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Mean vector and number of rows."""
    r = v.agg(vector_stat("mean", F.col("embedding")).alias("m"), F.count("*").alias("n")).first()
    return (np.asarray(r["m"]) if r["n"] else np.zeros(d)), r["n"]


def _project(v: DataFrame, k: int, centre: bool) -> tuple[DataFrame, list[float]]:
    v = written(v)
    first = v.select(F.size("embedding").alias("d")).first()
    if first is None:
        return v, []
    mean, n = _sums(v, first["d"])
    if not centre:
        mean = 0 * mean
    found = axes.solve(axes.dense_product(v, mean), first["d"], min(k, first["d"]), EXACT)
    value, w = found.value, axes.with_signs(found.vectors)
    at, lists = v.columns.index("embedding"), axes.lister()

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = lists((b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - mean) @ w)
                yield pa.RecordBatch.from_arrays([x if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in v.schema)
    return v.mapInArrow(run, fields), [float(max(x, 0) / max(n - 1, 1)) for x in value]


def pca_embedding(v: DataFrame, k: int) -> DataFrame:
    """Vectors projected on the first k principal axes of their covariance, centred; signs fixed."""
    return _project(v, k, True)[0]


def svd_embedding(v: DataFrame, k: int) -> DataFrame:
    """The same without centring: truncated singular vectors of the matrix as it is."""
    return _project(v, k, False)[0]


def pca_genes(expr: DataFrame, cells: DataFrame, genes: DataFrame, k: int) -> tuple[DataFrame, axes.Axes]:
    """Principal axes of the long matrix over `genes`, zeros implicit, centred inside the products: (cell_id, embedding) and the axes with their residuals."""
    return axes.sparse_axes(expr, cells, genes, k, True, EXACT)


def svd_genes(expr: DataFrame, cells: DataFrame, genes: DataFrame, k: int) -> tuple[DataFrame, axes.Axes]:
    """Truncated singular vectors of the long matrix over `genes`, zeros implicit."""
    return axes.sparse_axes(expr, cells, genes, k, False, EXACT)


def random_projection(expr: DataFrame, d: int = 16, seed: int = 0, sd: float = 0.05) -> DataFrame:
    """Normal weights by gene and dimension, drawn from a hash once per gene; a cell's values add up multiples of its genes' weights, in partial sums."""
    key = lambda dim: F.concat_ws(":", "gene_id", dim.cast("string"), F.lit(str(seed)))
    draw = lambda dim, tag: uniform(F.md5(F.concat(key(dim), F.lit(tag))))
    weight = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: sd * F.sqrt(-2 * F.log(1 - draw(i, ":a"))) * F.cos(2 * F.pi() * draw(i, ":b")))
    drawn = written(expr.select("gene_id").distinct().select("gene_id", weight.alias("w")))  # a row per gene
    x = expr.join(drawn, "gene_id").select("cell_id", F.transform("w", lambda w: w * F.col("value")).alias("w"))
    return x.groupBy("cell_id").agg(vector_stat("sum", F.col("w")).alias("embedding"))


def l2_normalize(v: DataFrame) -> DataFrame:
    return v.withColumn("__n", l2(F.col("embedding"))).withColumn("embedding", F.when(F.col("__n") > 0, F.transform("embedding", lambda x: x / F.col("__n"))).otherwise(F.col("embedding"))).drop("__n")


def concat_embeddings(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("cell_id", F.col("embedding").alias("__b")), "cell_id").withColumn("embedding", F.concat("embedding", "__b")).drop("__b")


def top_variance(values: DataFrame, n: int) -> DataFrame:
    """values(sample_id, gene_id, value), dense -> the n genes with the largest variance over samples."""
    return values.groupBy("gene_id").agg(F.round(F.var_samp("value"), 6).alias("variance")).orderBy(F.desc("variance"), "gene_id").limit(n)
