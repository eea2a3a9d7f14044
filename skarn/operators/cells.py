"""Filters, label handling and profiles of the cell table."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_substring, in_all, mapped


def filter_cells_in(df: DataFrame, spec: list[dict]) -> DataFrame:
    return df.where(in_all(spec))


def encode_labels(df: DataFrame, label_map: dict, col: str = "label_raw", out: str = "code") -> DataFrame:
    """Explicit map; values it lacks become null."""
    return df.withColumn(out, mapped(col, label_map))


def encode_sorted(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Sorted distinct values as 0, 1, ...; the window runs over the distinct values only."""
    codes = df.select(col).where(F.col(col).isNotNull()).distinct().withColumn(out, F.row_number().over(Window.orderBy(col)) - 1)
    return df.join(codes, col, "left")


def stratum_key(df: DataFrame, *cols: str, out: str = "stratum") -> DataFrame:
    return df.withColumn(out, F.concat_ws("|", *cols))


def patient_info(cells: DataFrame, patient: str = "sample_id", label: str = "label") -> DataFrame:
    return cells.groupBy(patient).agg(F.min(label).alias(label), F.count("*").alias("n_cells"))


def filter_patients(cells: DataFrame, min_cells: int = 100, n_splits: int = 5, patient: str = "sample_id", label: str = "label") -> DataFrame:
    """Patients with enough cells, and the splits that the smallest class allows."""
    kept = patient_info(cells, patient, label).where(F.col("n_cells") >= min_cells)
    smallest = kept.groupBy(label).count().agg(F.least(F.lit(n_splits), F.min("count")).cast("int").alias("n_splits"))
    return kept.crossJoin(smallest)  # one row


def label_conflicts(cells: DataFrame, sample: str = "sample_id", label: str = "label") -> DataFrame:
    """Samples with more than one label."""
    return cells.groupBy(sample).agg(F.countDistinct(label).alias("n_labels")).where("n_labels > 1")


def assert_single_label(cells: DataFrame, sample: str = "sample_id", label: str = "label") -> DataFrame:
    bad = label_conflicts(cells, sample, label).limit(5).collect()
    if bad:
        raise ValueError(f"samples with several labels: {[r[0] for r in bad]}")
    return cells


def coerce_response(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """Numbers, null where the text is none; nulls go; the smallest value of each id stays."""
    return df.select(id_col, F.expr(f"try_cast({value} AS double)").alias(value)).where(F.col(value).isNotNull()).groupBy(id_col).agg(F.min(value).alias(value))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


#: Families by substring, in the order they are tried.
FAMILIES = [("hvg", "HVG"), ("pca", "PCA"), ("scvi", "scVI"), ("gf", "Geneformer"), ("scgpt", "scGPT"), ("scimilarity", "SCimilarity"), ("cellplm", "CellPLM"), ("state", "STATE")]


def model_group(df: DataFrame, col: str = "model", out: str = "group") -> DataFrame:
    return df.withColumn(out, by_substring(col, FAMILIES, "other"))


def lookup(df: DataFrame, col: str, mapping: dict, out: str, keep: bool = False) -> DataFrame:
    """Display names; a value without one becomes null, or stays as it is with keep."""
    found = mapped(col, mapping)
    return df.withColumn(out, F.coalesce(found, F.col(col)) if keep else found)


def parse_run_name(df: DataFrame, col: str, left: str, right: str) -> DataFrame:
    """run: the name without '_exp'; part: the text between two marks, null without them."""
    rest = F.element_at(F.split(F.col(col), left, 2), 2)
    part = F.when(F.col(col).contains(left), F.element_at(F.split(rest, right, 2), 1))
    return df.withColumn("run", F.regexp_replace(col, "_exp", "")).withColumn("part", part)


def embedding_key(df: DataFrame, pairs: list[tuple[str, str]], col: str = "model", out: str = "key") -> DataFrame:
    """The last matching pair wins."""
    return df.withColumn(out, by_substring(col, pairs[::-1], None))


def with_order(cells: DataFrame, expr: DataFrame) -> DataFrame:
    """Explicit keys instead of positions: cells with their total counts, 0 where a cell has none."""
    totals = expr.groupBy("cell_id").agg(F.sum("value").alias("n_counts"))
    return cells.join(totals, "cell_id", "left").withColumn("n_counts", F.coalesce("n_counts", F.lit(0.0)))
