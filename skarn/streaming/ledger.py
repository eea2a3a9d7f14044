"""Run ledgers as a stream."""

from pyspark.sql import SparkSession


def stream_ledger(spark: SparkSession, path: str, schema, target: str, checkpoint: str, late: str = "1 day"):
    """Ledger rows as they arrive, each run once; runs until what is there has been taken.

    Rows that come more than `late` after the latest `started` seen in an earlier batch are dropped, as the state that tells repeated runs apart is kept that long; a run that comes again later than that is written again."""
    rows = spark.readStream.schema(schema).parquet(path).withWatermark("started", late).dropDuplicatesWithinWatermark(["run_id"])
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
