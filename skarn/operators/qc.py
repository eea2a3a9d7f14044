"""Quality control, normalisation and statistics of the long matrix expr(cell_id, gene_id, value): absent rows are zeros."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def cell_qc(cells: DataFrame, expr: DataFrame) -> DataFrame:
    q = expr.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("n_genes_by_counts"), F.sum("value").alias("total_counts"))
    return cells.select("cell_id").join(q, "cell_id", "left").select("cell_id", F.coalesce("n_genes_by_counts", F.lit(0)).alias("n_genes_by_counts"), F.coalesce("total_counts", F.lit(0.0)).alias("total_counts"))


def gene_qc(expr: DataFrame, n_cells: int) -> DataFrame:
    """Means and dropout over all cells, not over nonzeros."""
    q = expr.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    return q.select("gene_id", "n_cells_by_counts", "total_counts", (F.col("total_counts") / n_cells).alias("mean_counts"), (100 - 100 * F.col("n_cells_by_counts") / n_cells).alias("pct_dropout_by_counts"))


def qc(expr: DataFrame, min_genes: int, min_cells: int) -> DataFrame:
    """Cells first, then genes among the cells left."""
    cells = expr.where("value > 0").groupBy("cell_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_genes)
    kept = expr.join(cells, "cell_id", "left_semi")
    genes = kept.where("value > 0").groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells)
    return kept.join(genes, "gene_id", "left_semi")


def filter_genes_frac(expr: DataFrame, n_cells: int, frac: float = 0.01) -> DataFrame:
    genes = expr.where("value > 0").groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") / n_cells >= frac)
    return expr.join(genes, "gene_id", "left_semi")


def normalize_total(expr: DataFrame, target_sum: float | None = 1e4) -> DataFrame:
    """Each cell's values scaled to the same total; without a target, to the median of totals over 0."""
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("total"))
    if target_sum is None:
        goal = quantiles(totals.where("total > 0"), "total", [0.5]).select(F.col("quantiles")[0].alias("goal"))
        totals = totals.crossJoin(F.broadcast(goal))  # one row
    else:
        totals = totals.withColumn("goal", F.lit(float(target_sum)))
    scaled = F.when(F.col("total") > 0, F.col("value") * F.col("goal") / F.col("total")).otherwise(F.col("value"))
    return expr.join(totals, "cell_id").select("cell_id", "gene_id", scaled.alias("value"))


def log1p(expr: DataFrame, base: float | None = None) -> DataFrame:
    v = F.log1p("value")
    return expr.withColumn("value", v / F.log(F.lit(float(base))) if base else v)


def snapshot_layer(layers: DataFrame, source: str, name: str) -> DataFrame:
    """Adds a copy of one layer under a name, unless that layer is there already."""
    there = layers.where(F.col("layer") == name).select(F.lit(1).alias("x")).limit(1)
    copy = layers.where(F.col("layer") == source).withColumn("layer", F.lit(name)).join(F.broadcast(there), F.lit(True), "left_anti")
    return layers.unionByName(copy)


def counts_layer(layers: DataFrame, order: list[str]) -> DataFrame:
    """The first layer of an ordered list that exists."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    first = layers.where(F.col("layer").isin(order)).agg(F.min(rank).alias("first"))
    return layers.crossJoin(F.broadcast(first)).where(rank == F.col("first")).drop("first")


def gene_moments(expr: DataFrame, n_cells: int, by: list[str] | None = None) -> DataFrame:
    """Mean and variance (n - 1) with implicit zeros. by: further keys; n_cells may be a column."""
    m = expr.groupBy("gene_id", *(by or [])).agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n = F.lit(n_cells) if not isinstance(n_cells, type(F.lit(1))) else n_cells
    return m.select("gene_id", *(by or []), (F.col("s") / n).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)).alias("var"))


def scale(expr: DataFrame, cells: DataFrame, max_value: float = 10.0) -> DataFrame:
    """Mean 0 and deviation 1 for each gene, clipped; dense over the genes given."""
    n = cells.count()
    m = gene_moments(expr, n).withColumn("sd", F.sqrt(F.greatest("var", F.lit(0.0))))
    grid = m.select("gene_id", "mean", "sd").crossJoin(cells.select("cell_id"))
    z = (F.coalesce("value", F.lit(0.0)) - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return grid.join(expr, ["cell_id", "gene_id"], "left").select("cell_id", "gene_id", F.least(F.greatest(z, F.lit(-max_value)), F.lit(max_value)).alias("value"))


def scale_stored(expr: DataFrame, cells: DataFrame, max_value: float = 10.0) -> DataFrame:
    """As `scale`, zeros staying implicit: a row per stored value, and per gene (cell_id null) one row with the value that its zeros take.

    As many rows as expr and its genes have, whatever the number of cells."""
    n = cells.count()
    m = gene_moments(expr, n).withColumn("sd", F.sqrt(F.greatest("var", F.lit(0.0))))
    x = expr.select("cell_id", "gene_id", "value").unionByName(m.select(F.lit(None).cast("string").alias("cell_id"), "gene_id", F.lit(0.0).alias("value")))
    z = (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return x.join(m.select("gene_id", "mean", "sd"), "gene_id").select("cell_id", "gene_id", F.least(F.greatest(z, F.lit(-max_value)), F.lit(max_value)).alias("value"))


def matrix_range(expr: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """Smallest and largest value; zeros that are not stored count."""
    zero = F.count("*") < n_cells * n_genes
    return expr.agg(F.when(zero, F.least(F.min("value"), F.lit(0.0))).otherwise(F.min("value")).alias("min_value"), F.when(zero, F.greatest(F.max("value"), F.lit(0.0))).otherwise(F.max("value")).alias("max_value"), F.count("*").alias("stored"))


#: Shares, bounds and the pattern of the definitions of kinds.
WHOLE, LOG_MOST, LOG_P99, SYMBOL = 0.99, 20, 15, r"^[A-Za-z][A-Za-z0-9.-]{0,14}$"


def infer_matrix_kind(expr: DataFrame) -> DataFrame:
    """raw_counts, log_normalized, other_processed or unspecified, from the stored values."""
    v = F.col("value")
    s = expr.agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg((F.abs(v - F.round(v)) < 1e-6).cast("double")).alias("whole"))
    q = quantiles(expr, "value", [0.5, 0.99])  # no row without values
    s = s.join(F.broadcast(q.select(F.col("quantiles")[0].alias("mid"), F.col("quantiles")[1].alias("p99"))), F.lit(True), "left")  # one row
    kind = F.when(F.col("n") == 0, "unspecified").when((F.col("lo") >= 0) & (F.col("whole") >= WHOLE), "raw_counts").when((F.col("lo") >= 0) & (F.col("hi") <= LOG_MOST) & (F.col("p99") <= LOG_P99), "log_normalized").otherwise("other_processed")
    return s.select("hi", "mid", "p99", "whole", kind.alias("kind"))


def infer_gene_id_kind(genes: DataFrame, col: str) -> DataFrame:
    ens = F.avg(F.col(col).rlike(r"(?i)^ENS[A-Z]{0,10}G\d{6,}").cast("double"))
    sym = F.avg(F.col(col).rlike(SYMBOL).cast("double"))
    s = genes.agg(ens.alias("ensembl_share"), sym.alias("symbol_share"))
    return s.withColumn("kind", F.when(F.col("ensembl_share") > 0.5, "ensembl").when(F.col("symbol_share") > 0.5, "symbol").otherwise("unknown"))


def audit_embeddings(df: DataFrame, expected: int, key: str) -> DataFrame:
    a = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.max(F.size("embedding")).alias("dims"))
    return a.withColumn("unexpected", F.col("n_rows") != expected)


def describe(df: DataFrame, *cols: str) -> DataFrame:
    """Count, mean, deviation, quartiles and distinct values of numeric columns, one row each."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"), F.countDistinct(c).alias("n_distinct")) for c in cols]
    stats = df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("r")).select("r.*")
    q = quantiles(long, "value", [0.25, 0.5, 0.75], ["column"]).select("column", *[F.col("quantiles")[i].alias(f"q{i + 1}") for i in range(3)])
    return stats.join(q, "column", "left").select("column", "n", "mean", "sd", "lo", "q1", "q2", "q3", "hi", "n_distinct")
