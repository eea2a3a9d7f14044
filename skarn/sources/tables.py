"""Readers and writers of matrices, splits, embeddings, panels and evaluation tables."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_expression(cells: DataFrame, layers: DataFrame, label_key: str, batch_key: str, layer: str = "X", raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cells with label and batch copied from their columns, and the values of one layer (the filter reaches the scan)."""
    missing = {label_key, batch_key} - set(cells.columns)
    if missing:
        raise KeyError(f"missing cell columns: {sorted(missing)}")
    return cells.withColumn("label", F.col(label_key)).withColumn("batch", F.col(batch_key)), layers.where(F.col("layer") == ("raw" if raw else layer)).drop("layer")


def read_feature_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """label and features (all other columns, in order) of a CSV with a header."""
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    return df.select("label", F.array(*[F.col(f"`{c}`").cast("double") for c in df.columns if c != "label"]).alias("features"))


_FOLD = "struct<train_ids: array<string>, test_ids: array<string>, train_labels: array<string>, test_labels: array<string>>"


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents {fold_k | train_test_split: {train_ids, test_ids, train_labels, test_labels}, ...} -> fold, role, id, label. Ids and labels are aligned by place."""
    text = spark.read.option("wholetext", True).text(path)
    folds = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("name", "body")).where(F.col("name").rlike(r"^(fold_\d+|train_test_split)$"))
    x = folds.select(F.coalesce(F.try_to_number(F.regexp_extract("name", r"(\d+)$", 1), F.lit("999999")).cast("int"), F.lit(0)).alias("fold"), F.from_json("body", _FOLD).alias("b"))
    sides = [x.select("fold", F.lit(r).alias("role"), F.explode(F.arrays_zip(F.col(f"b.{r}_ids").alias("id"), F.col(f"b.{r}_labels").alias("label"))).alias("z")) for r in ("train", "test")]
    return sides[0].unionAll(sides[1]).select("fold", "role", F.col("z.id").alias("id"), F.col("z.label").alias("label"))


def splits_document(splits: DataFrame, id_column: str, label_column: str, seed: int) -> DataFrame:
    """splits(fold, role, id, label) as one JSON text in the readers' form."""
    side = lambda r, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("id", "label")))), lambda s: s[c].cast("string"))
    f = splits.groupBy("fold").agg(F.struct(side("train", "id").alias("train_ids"), side("test", "id").alias("test_ids"), side("train", "label").alias("train_labels"), side("test", "label").alias("test_labels")).alias("body"))
    folds = f.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("fold_"), "fold").alias("k"), F.to_json("body").alias("v"))))).alias("m"), F.count("*").alias("n_splits"))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"]))
    tail = F.format_string(f'"id_column": "{id_column}", "label_column": "{label_column}", "random_state": {seed}, "n_splits": %d', "n_splits")
    return folds.select(F.concat(F.lit("{"), F.concat_ws(", ", entries), F.lit(", "), tail, F.lit("}")).alias("value"))


def write_splits(splits: DataFrame, path: str, id_column: str = "id", label_column: str = "label", seed: int = 0) -> None:
    """The document as text, and the rows as CSV by role."""
    splits_document(splits, id_column, label_column, seed).write.mode("overwrite").text(f"{path}/json")
    splits.write.mode("overwrite").partitionBy("role").option("header", True).csv(f"{path}/csv")


def save_embedding(emb: DataFrame, path: str, key: str) -> None:
    emb.withColumn("key", F.lit(key)).write.mode("append").partitionBy("key").parquet(path)


def load_embedding(spark: SparkSession, path: str, key: str, fallback=None) -> DataFrame:
    """The stored embedding; where there is none, fallback() is computed and stored."""
    try:
        found = spark.read.parquet(path).where(F.col("key") == key)
        if not found.isEmpty():
            return found.drop("key")
    except AnalysisException:
        pass
    if fallback is None:
        raise FileNotFoundError(f"no embedding {key} at {path}")
    save_embedding(fallback(), path, key)
    return spark.read.parquet(path).where(F.col("key") == key).drop("key")


def read_gene_panel(spark: SparkSession, path: str, tsv_column: str | None = None) -> DataFrame:
    """gene_id, pos: a TSV's column, or the first comma field of text lines that are neither blank nor comments. pos is the line within the file, without a TSV's header."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    if tsv_column:
        place = F.array_position(F.split(F.col("lines")[0], "\t"), tsv_column).cast("int")
        rows = lines.select(F.when(place > 0, place).otherwise(F.raise_error(F.lit(f"no column {tsv_column}"))).alias("at"), F.posexplode("lines").alias("pos", "line"))
        return rows.where("pos > 0 and line <> ''").select(F.get(F.split("line", "\t"), F.col("at") - 1).alias("gene_id"), (F.col("pos") - 1).cast("long").alias("pos"))
    lines = lines.select(F.posexplode("lines").alias("pos", "line"))
    return lines.where("trim(line) <> '' and not startswith(trim(line), '#')").select(F.trim(F.split("line", ",")[0]).alias("gene_id"), F.col("pos").cast("long").alias("pos"))


def write_eval(df: DataFrame, path: str) -> None:
    """Predictions or scores as CSV by strategy and role."""
    df.write.mode("overwrite").partitionBy("strategy", "role").option("header", True).csv(path)


def read_eval(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
