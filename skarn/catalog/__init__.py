"""One query per operator, with the SQL that gives the same rows."""

import importlib
import os

from ..plans.adapters import registered

_MODULES = ("cell_queries", "feature_queries", "graph_queries", "report_queries", "source_queries")


def _prepared(f):
    def run(spark, sf_dir):
        # Python workers find the package wherever the driver was started.
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        env = spark.sparkContext.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(p for p in (root, env.get("PYTHONPATH")) if p)
        return f(spark, sf_dir)

    return run


def queries():
    for m in _MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return {k: _prepared(f) for k, f in registered()[0].items()}


def oracle_sql():
    queries()
    return dict(registered()[1])
