"""What the training-data operators share: shared folder, written tables, components."""

import gc
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import shared_dir

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, so that a batch of very long texts stays a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, env.get("PYTHONPATH")) if p)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of comparable ids -> (node, component_id), the smallest id reachable; nodes without edges are absent.

    Contraction: each node moves to the smallest id among itself and its neighbours (two steps
    a round), edges are relabelled and made distinct, until none is left. Every round is written to
    the shared folder. Null ends and loops are ignored.
    """
    e = written(edges.where("a is not null and b is not null").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("component_id", F.col("node"))
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        p = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("p")))
        q = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        p = written(p.join(q, "p").select("u", F.col("pp").alias("p")))
        labels = written(
            labels.join(p, labels.component_id == p.u, "left")
            .select("node", F.coalesce("p", "component_id").alias("component_id")))
        pa, pb = p.select(F.col("u").alias("a"), F.col("p").alias("na")), p.select(F.col("u").alias("b"), F.col("p").alias("nb"))
        e = written(e.join(pa, "a").join(pb, "b").select(
            F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a <> b").distinct())
    return labels


def through_arrow(docs: DataFrame, run) -> DataFrame:
    """docs.mapInArrow(run) with the same columns, which are numbered meanwhile: names may hold dots."""
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def labelled(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """docs(doc_id, text) of the ids in picked(doc_id, ...), a bounded table: one row per id whatever repeats, with the text of the smallest hash. Written."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked.select("doc_id")), "doc_id")
    one = text.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    return written(one.join(F.broadcast(picked), "doc_id"))


_SLOT: dict = {}


def worker_memory(key, make):
    """What a Python worker remembers from task to task: make() once for a key. One key at a time, so that a worker which goes on to another operator lets go of the last one's."""
    if key not in _SLOT:
        _SLOT.clear()
        gc.collect()
        _SLOT[key] = make()
    return _SLOT[key]
