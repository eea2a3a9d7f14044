"""Run ledgers, metric files and results documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_run(row: DataFrame, path: str) -> None:
    """A run's row; columns may grow over time, each append is its own file."""
    row.write.mode("append").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def scan_runs(spark: SparkSession, root: str, filename: str, contains: str = "") -> DataFrame:
    """Metric CSVs named filename anywhere below root, with the run (their folder's name); paths must hold `contains`."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", filename).schema("metric string, value double, fold int").csv(root)
    df = df.withColumn("path", F.col("_metadata.file_path"))
    return df.where(F.col("path").contains(contains)).withColumn("run_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).drop("path")


def attach_metadata(rows: DataFrame, meta: DataFrame) -> DataFrame:
    return rows.join(meta, "run_id", "left")


def parse_cv_metrics(df: DataFrame) -> DataFrame:
    """Rows (metric, name ending in the fold, value) -> metric, folds as an ordered array, and their mean."""
    fold = F.regexp_extract("name", r"(\d+)$", 1)
    x = df.withColumn("fold", F.when(fold != "", fold.cast("int"))).where("fold is not null")
    return x.groupBy("run_id", "metric").agg(F.array_sort(F.collect_list(F.struct("fold", "value"))).alias("folds"), F.avg("value").alias("mean"))


def build_results(metrics: DataFrame) -> DataFrame:
    """metrics(run_id, kind, variant, fold, metric, value) -> run_id, evaluations: array of {kind, variant, aggregate, folds}."""
    fold = metrics.groupBy("run_id", "kind", "variant", "fold").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    folds = fold.groupBy("run_id", "kind", "variant").agg(F.collect_list(F.struct("fold", "metrics")).alias("folds"))
    agg = metrics.groupBy("run_id", "kind", "variant", "metric").agg(F.avg("value").alias("value")).groupBy("run_id", "kind", "variant").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("aggregate"))
    by_fold = F.array_sort("folds", lambda a, b: F.when(a["fold"] < b["fold"], -1).when(a["fold"] > b["fold"], 1).otherwise(0))
    x = folds.join(agg, ["run_id", "kind", "variant"]).select("run_id", F.struct("kind", "variant", "aggregate", by_fold.alias("folds")).alias("e"))
    order = lambda a, b: F.when(F.concat(a["kind"], F.lit("|"), a["variant"]) < F.concat(b["kind"], F.lit("|"), b["variant"]), -1).otherwise(1)
    return x.groupBy("run_id").agg(F.array_sort(F.collect_list("e"), order).alias("evaluations"))


def merge_evaluation(docs: DataFrame, new: DataFrame) -> DataFrame:
    """new(run_id, evaluation) takes the place of the evaluation with its kind and variant, or is added."""
    x = docs.join(new, "run_id", "left")
    rest = F.filter("evaluations", lambda e: ~((e["kind"] == F.col("evaluation")["kind"]) & (e["variant"] == F.col("evaluation")["variant"])))
    return x.select("run_id", F.when(F.col("evaluation").isNull(), F.col("evaluations")).otherwise(F.concat(rest, F.array("evaluation"))).alias("evaluations"))
