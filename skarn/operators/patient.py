"""Patient-level pooling, votes and attention tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import vector_stat
from .splits import ranked


def mean_embedding(emb: DataFrame, cells: DataFrame, sample: str = "sample_id") -> DataFrame:
    x = emb.join(cells.select("cell_id", sample), "cell_id")
    return x.groupBy(sample).agg(F.transform(vector_stat("mean", F.col("embedding")), lambda v: F.round(v, 6)).alias("embedding"))


def pseudobulk(expr: DataFrame, cells: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Mean expression by sample and gene; zeros of cells without a row count."""
    n = cells.groupBy(sample).agg(F.count("*").alias("n"))
    s = expr.join(cells.select("cell_id", sample), "cell_id").groupBy(sample, "gene_id").agg(F.sum("value").alias("s"))
    return s.join(n, sample).select(sample, "gene_id", (F.col("s") / F.col("n")).alias("mean"))


def composition(cells: DataFrame, sample: str = "sample_id", cell_type: str = "cell_type", types: list[str] | None = None) -> DataFrame:
    """Shares of cell types by sample, wide, 0 where a sample has none."""
    types = types or sorted(r[0] for r in cells.select(cell_type).distinct().collect())
    w = cells.groupBy(sample).pivot(cell_type, types).count().fillna(0, types)
    total = sum((F.col(f"`{t}`") for t in types[1:]), F.col(f"`{types[0]}`"))
    return w.select(sample, *[(F.col(f"`{t}`") / total).alias(t) for t in types])


def vote(preds: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Most frequent prediction (ties: the lowest class), mean score, label."""
    p = preds.groupBy(sample, "pred").agg(F.count("*").alias("n"), F.sum("pred_score").alias("s"), F.min("label").alias("label"))
    return p.groupBy(sample).agg(F.max_by("pred", F.struct("n", -F.col("pred"))).alias("pred"), (F.sum("s") / F.sum("n")).alias("pred_score"), F.min("label").alias("label"))


def prob_average(preds: DataFrame, sample: str = "sample_id", threshold: float = 0.5) -> DataFrame:
    return preds.groupBy(sample).agg(F.avg("pred_score").alias("pred_score"), F.min("label").alias("label")).withColumn("pred", (F.round("pred_score", 9) > threshold).cast("int"))


def vote_share(preds: DataFrame, sample: str = "sample_id") -> DataFrame:
    return preds.groupBy(sample, "pred").count().groupBy(sample).agg((F.max("count") / F.sum("count")).alias("share"))


def attention(logits: DataFrame, bag: str, temperature: float = 1.0) -> DataFrame:
    """logits(bag, cell_id, logit) with attn, the softmax inside each bag; sums are joined back, so large bags stay dealt out."""
    m = logits.groupBy(bag).agg(F.max("logit").alias("m"))
    x = logits.join(m, bag).withColumn("e", F.exp((F.col("logit") - F.col("m")) / temperature)).drop("m")
    return x.join(x.groupBy(bag).agg(F.sum("e").alias("z")), bag).withColumn("attn", F.col("e") / F.col("z")).drop("e", "z")


def attention_pool(emb: DataFrame, logits: DataFrame, bag: str, temperature: float = 1.0) -> DataFrame:
    x = emb.select("cell_id", "embedding").join(attention(logits, bag, temperature), "cell_id")
    return x.groupBy(bag).agg(F.transform(vector_stat("sum", F.col("embedding"), F.col("attn")), lambda v: F.round(v, 6)).alias("embedding"))


def attention_frame(attn: DataFrame, bag: str, top_k: int) -> DataFrame:
    """attn(bag, cell_id, attn, score) with rank, contrib, the bag's normalised entropy and size, and the top-k mark."""
    s = attn.groupBy(bag).agg(F.sum(F.when(F.col("attn") > 0, -F.col("attn") * F.log("attn")).otherwise(0.0)).alias("h"), F.count("*").alias("n_cells"))
    x = attn.join(s, bag)
    x = ranked(x, [bag], [-F.round("attn", 9), F.col("cell_id")]).withColumn("rank", F.col("__nth").cast("int")).drop("__nth", "__size").withColumn("contrib", F.col("attn") * F.col("score"))
    return x.withColumn("entropy", F.when(F.col("n_cells") > 1, F.col("h") / F.log(F.col("n_cells"))).otherwise(0.0)).withColumn("is_topk", (F.col("rank") <= top_k).cast("int")).drop("h")


def attention_by_type(frame: DataFrame, types: list[str], outcome: str = "label") -> DataFrame:
    """Mean attention by outcome and cell type, wide, 0 where none."""
    return frame.groupBy(outcome).pivot("cell_type", types).agg(F.round(F.avg("attn"), 6)).fillna(0.0, types)


def top_type(frame: DataFrame, bag: str) -> DataFrame:
    """Of each bag's top cells, the type with the largest total attention; ties by name."""
    t = frame.where("is_topk = 1").groupBy(bag, "cell_type").agg(F.round(F.sum("attn"), 6).alias("attn"))
    nth = F.row_number().over(Window.partitionBy(bag).orderBy(F.desc("attn"), "cell_type"))
    return t.withColumn("nth", nth).where("nth = 1").drop("nth")


def bag_table(frame: DataFrame, bag: str) -> DataFrame:
    return frame.groupBy(bag).agg(F.max("entropy").alias("bag_entropy"), F.max("n_cells").alias("n_cells"), F.max("label").alias("label"))


def marker_table(expr: DataFrame, clusters: DataFrame, markers: DataFrame) -> DataFrame:
    """clusters(cell_id, cluster), markers(gene_id): mean expression and detected share by cluster, the mean scaled to 0..1 over clusters; absent markers have nulls."""
    size = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    x = expr.join(markers.select("gene_id").distinct(), "gene_id").join(clusters, "cell_id").groupBy("cluster", "gene_id").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    there = expr.select("gene_id").distinct().join(markers.select("gene_id").distinct(), "gene_id", "left_semi")
    grid = there.crossJoin(size).join(x, ["cluster", "gene_id"], "left")  # markers x clusters
    g = grid.select("gene_id", "cluster", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"), (F.coalesce("k", F.lit(0)) / F.col("n")).alias("detected"))
    w = Window.partitionBy("gene_id")
    lo, hi = F.min("mean").over(w), F.max("mean").over(w)
    g = g.withColumn("scaled", F.when(hi > lo, (F.col("mean") - lo) / (hi - lo)).otherwise(0.0))
    return markers.select("gene_id").distinct().join(g, "gene_id", "left")
