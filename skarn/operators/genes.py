"""Gene identifiers: mapping between symbols and stable identifiers, panels and vocabularies."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ensembl_stable


def map_symbols(genes: DataFrame, names: DataFrame, col: str = "gene_name") -> DataFrame:
    """Symbol to identifier: exact, then in capitals, then parsed from the label; genes without one go. names(symbol, ensembl_id)."""
    exact = names.groupBy("symbol").agg(F.min("ensembl_id").alias("by_exact")).withColumnRenamed("symbol", "__s")
    upper = names.groupBy(F.upper("symbol").alias("u")).agg(F.min("ensembl_id").alias("by_upper"))
    g = genes.join(exact, F.col(col) == F.col("__s"), "left").join(upper, F.upper(col) == F.col("u"), "left")
    found = F.coalesce("by_exact", "by_upper", ensembl_stable(col))
    route = F.when(F.col("by_exact").isNotNull(), "exact").when(F.col("by_upper").isNotNull(), "upper").otherwise("parsed")
    return g.select(*genes.columns, found.alias("mapped_id"), route.alias("route")).where("mapped_id is not null")


def map_ensembl(genes: DataFrame, names: DataFrame, col: str = "ensembl_id", order: str = "pos") -> DataFrame:
    """Identifier to symbol; genes without one go; later ones of a symbol get -1, -2, ..."""
    by = names.groupBy("ensembl_id").agg(F.min("symbol").alias("name"))
    g = genes.join(by.withColumnRenamed("ensembl_id", "e"), F.col(col) == F.col("e"))
    nth = F.row_number().over(Window.partitionBy("name").orderBy(order)) - 1
    return g.select("gene_id", F.when(nth == 0, F.col("name")).otherwise(F.concat("name", F.lit("-"), nth)).alias("unique_name"))


def coerce_map(pairs: DataFrame, order: str = "pos", sample: int = 50) -> DataFrame:
    """pairs(a, b, order) -> identifier, symbol (the last one wins), collisions. The side with identifiers is told from the first rows."""
    first = pairs.orderBy(order).limit(sample)
    side = first.agg((F.avg(ensembl_stable("a").isNotNull().cast("double")) >= F.avg(ensembl_stable("b").isNotNull().cast("double"))).alias("a_first"))
    p = pairs.crossJoin(F.broadcast(side)).select(F.when(F.col("a_first"), F.col("a")).otherwise(F.col("b")).alias("ensembl_id"), F.when(F.col("a_first"), F.col("b")).otherwise(F.col("a")).alias("symbol"), order)
    return p.groupBy("ensembl_id").agg(F.max_by("symbol", order).alias("symbol"), (F.countDistinct("symbol") > 1).alias("collision"))


def choose_id_source(genes: DataFrame, column: str, index: str) -> DataFrame:
    """column, index or dictionary: the first whose labels are mostly stable identifiers."""
    s = genes.agg(F.avg(ensembl_stable(column).isNotNull().cast("double")).alias("in_column"), F.avg(ensembl_stable(index).isNotNull().cast("double")).alias("in_index"))
    return s.withColumn("source", F.when(F.col("in_column") > 0.5, "column").when(F.col("in_index") > 0.5, "index").otherwise("dictionary"))


def resolve_key(genes: DataFrame, vocab: DataFrame, names: DataFrame, cols: list[str]) -> DataFrame:
    """First hit in vocab(key) over the label columns and, for each, exact, capitals, identifier's symbol."""
    tries = F.array(*[F.struct(F.lit(3 * i + j).alias("priority"), e.alias("key")) for i, c in enumerate(cols) for j, e in enumerate((F.col(c), F.upper(c)))])
    flat = genes.select("gene_id", F.explode(tries).alias("t")).select("gene_id", "t.priority", "t.key")
    by = names.groupBy("ensembl_id").agg(F.min("symbol").alias("symbol"))
    for i, c in enumerate(cols):
        flat = flat.unionByName(genes.select("gene_id", F.lit(3 * i + 2).alias("priority"), ensembl_stable(c).alias("e")).join(by, F.col("e") == F.col("ensembl_id")).select("gene_id", "priority", F.col("symbol").alias("key")))
    return flat.join(vocab.select("key").distinct(), "key").groupBy("gene_id").agg(F.min_by("key", "priority").alias("key"), F.min("priority").alias("priority"))


def panel_overlap(genes: DataFrame, panel: DataFrame, key: str = "gene_id") -> DataFrame:
    g, p = genes.groupBy(key).agg(F.count("*").alias("n_data")), panel.select(key).distinct().withColumn("in_panel", F.lit(True))
    both = g.join(p, key, "full_outer")
    a, b = F.col("n_data").isNotNull(), F.col("in_panel").isNotNull()
    s = both.agg(F.count_if(a & b).alias("shared"), F.count_if(a & ~b).alias("only_data"), F.count_if(~a & b).alias("only_panel"), F.count_if(F.col("n_data") > 1).alias("repeated"))
    return s.withColumn("pct_of_panel", 100 * F.col("shared") / (F.col("shared") + F.col("only_panel"))).withColumn("pct_of_data", 100 * F.col("shared") / (F.col("shared") + F.col("only_data")))


def align_panel(expr: DataFrame, panel: DataFrame) -> DataFrame:
    """Values of panel(gene_id, pos) genes with their places; genes outside go, missing ones stay implicit zeros."""
    return expr.join(panel.select("gene_id", "pos"), "gene_id").select("cell_id", "gene_id", "pos", "value")


def panel_mask(expr: DataFrame, panel: DataFrame) -> DataFrame:
    """1 for panel genes that the data lack."""
    there = expr.select("gene_id").distinct().withColumn("there", F.lit(True))
    return panel.join(there, "gene_id", "left").select("gene_id", "pos", F.col("there").isNull().cast("int").alias("mask"))


def subset_reference(expr: DataFrame, reference: DataFrame, drop: bool = True) -> DataFrame:
    if not drop:
        bad = [r[0] for r in expr.select("gene_id").distinct().join(reference, "gene_id", "left_anti").limit(5).collect()]
        if bad:
            raise ValueError(f"genes outside the reference: {bad}")
    return expr.join(reference.select("gene_id").distinct(), "gene_id", "left_semi")


def subset_means(genes: DataFrame, means: DataFrame) -> DataFrame:
    """means(gene_id, mean) of the genes present, null where missing."""
    return genes.select("gene_id").distinct().join(means, "gene_id", "left")
