"""Written intermediate tables for iterative operators."""

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir; under a temporary folder only where that is unset and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="spark-skarn-")
            atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
        base = f"file://{_OWN['dir']}"
    return f"{base.rstrip('/')}/skarn-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
