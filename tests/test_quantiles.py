"""Exact quantiles against numpy, with groups sorted where they meet and groups searched by ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skarn.operators import qc, quantiles as Q

PROBS = [0.0, 0.25, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("small,bins,few", [(50, 200, 10_000), (20, 30, 0), (10_000, 2_048, 10_000)])
def test_quantiles_equal_a_full_sort(spark, monkeypatch, small, bins, few):
    monkeypatch.setattr(Q, "SMALL", small), monkeypatch.setattr(Q, "BINS", bins), monkeypatch.setattr(Q, "FEW", few)
    rng = np.random.default_rng(4)
    groups = {"normal": rng.normal(size=301), "ties": rng.integers(0, 3, 200).astype(float), "one": np.full(150, 7.5), "spread": 10.0 ** rng.uniform(-20, 20, 120), "few": np.asarray([3.0, 1.0]),
              "huge": rng.choice([-1.7e308, 1.7e308, 0.0], 90), "inf": np.r_[rng.normal(size=60), [np.inf] * 20, [-np.inf] * 5], None: np.arange(80.0), "mixed": np.r_[np.zeros(70), 1e9, 5e-324]}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r for r in Q.quantiles(df, "v", PROBS, ["g"]).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        s = np.sort(v)
        for p, x in zip(PROBS, got[k].quantiles, strict=True):
            at = (len(s) - 1) * p
            lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
            want = lo if lo == hi else (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi
            assert x == want or abs(x - want) <= 1e-12 * abs(want) or (np.isnan(x) and np.isnan(want)), (k, p, x, want)
        assert got[k].n == len(v)
    one = Q.quantiles(df.where("g = 'normal'"), F.col("v") * 2, [0.5]).first()
    assert one.n == 301 and one.quantiles == [2 * np.median(groups["normal"])]
    assert Q.quantiles(df.where("false"), "v", [0.5]).collect() == [] == Q.quantiles(df.where("false"), "v", [0.5], ["g"]).collect()


def test_no_task_gets_more_than_small_values(spark, monkeypatch):
    """One value more than SMALL goes through ranges; what is gathered in the end is under SMALL."""
    monkeypatch.setattr(Q, "SMALL", 100)
    df = spark.range(5000).select((F.col("id") * F.col("id") % 4999).cast("double").alias("v"))
    sizes, sort_array = [], F.sort_array
    monkeypatch.setattr(Q.F, "sort_array", lambda c: (sizes.append(1), sort_array(c))[1])
    assert Q.quantiles(df, "v", [0.5]).first().quantiles[0] == float(np.median([i * i % 4999 for i in range(5000)]))
    assert sizes == [1]


def test_matrix_statistics_by_ranges(spark, monkeypatch):
    """Normalisation without a target, matrix kind and description give the same with SMALL of 5."""
    rng = np.random.default_rng(2)
    rows = [(f"c{i % 23}", f"g{i % 17}", float(rng.integers(1, 40))) for i in range(391)]
    expr = spark.createDataFrame(rows, "cell_id string, gene_id string, value double")

    def answers():
        return [sorted(map(tuple, df.collect())) for df in (qc.normalize_total(expr, None), qc.infer_matrix_kind(expr), qc.describe(expr, "value"))]

    want = answers()
    monkeypatch.setattr(Q, "SMALL", 5)
    assert answers() == want
    totals: dict = {}
    for c, _, v in rows:
        totals[c] = totals.get(c, 0) + v
    goal = float(np.median(list(totals.values())))
    assert want[0] == sorted((c, g, v * goal / totals[c]) for c, g, v in rows)
    values = [v for _, _, v in rows]
    assert want[2][0][5:8] == tuple(np.percentile(values, [25, 50, 75]))
