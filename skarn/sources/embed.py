"""The plug-in point for embedders: a user's function on one cell's genes and values, run over Arrow batches of cells."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embed(expr: DataFrame, fn: Callable[[np.ndarray, np.ndarray], list[float]]) -> DataFrame:
    """fn(gene ids, values) -> vector, once per cell; genes in order of their ids."""
    cells = expr.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("gene_id", "value"))).alias("a")).select("cell_id", F.col("a.gene_id").alias("g"), F.col("a.value").alias("v"))

    def run(batches):
        for b in batches:
            out = [[float(x) for x in fn(np.asarray(g, object), np.asarray(v, "f8"))] for g, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["cell_id", "embedding"])

    return cells.mapInArrow(run, "cell_id string, embedding array<double>")
