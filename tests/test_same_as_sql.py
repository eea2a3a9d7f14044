"""Cases in which both engines once gave different rows: bins at edges, and means and sums that round to zero from below."""

import struct
from fractions import Fraction

import duckdb
import numpy as np

from skarn.catalog import oracle_sql, queries
from skarn.operators import tokens as T


def test_bins_count_edges_by_whole_numbers(spark):
    """Against edges in exact fractions; equal values, single values and lengths at which edges meet values."""
    rng = np.random.default_rng(3)
    cells = {"one": [7.1], "equal": [41.3] * 5, "two": [1.0, 2.0]} | {f"n{n}": (rng.integers(1, 30, n) / 10).tolist() for n in (3, 8, 15, 29, 50, 57, 99)}
    df = spark.createDataFrame([(c, str(i), v) for c, x in cells.items() for i, v in enumerate(x)] + [("two", "zero", 0.0)], "cell_id string, gene_id string, value double")
    got = {(r["cell_id"], r["gene_id"]): r["bin"] for r in T.bin_values(df, 51).collect()}
    assert len(got) == sum(map(len, cells.values()))
    for c, x in cells.items():
        a = sorted(map(Fraction, x))
        edges = []
        for i in range(1, 49):
            at = Fraction(i * (len(a) - 1), 49)
            low = int(at)
            edges.append(a[low] + (a[min(low + 1, len(a) - 1)] - a[low]) * (at - low))
        assert [got[c, str(i)] for i in range(len(x))] == [1 + sum(e < Fraction(v) for e in edges) for v in x]


def _bits(v):
    return [_bits(x) for x in v] if isinstance(v, (list, tuple)) else struct.pack("d", v) if isinstance(v, float) else v


def _same_bits(spark, path, name, tables):
    """Rows of the query and of its SQL over the written tables agree to the last bit, the sign of zero included."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    cur = con.execute(oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    got = [[_bits(r[c]) for c in cols] for r in queries()[name](spark, str(path)).collect()]
    assert got and sorted(got, key=repr) == sorted((_bits(list(r)) for r in cur.fetchall()), key=repr)


def test_projections_that_round_to_zero(spark, tmp_path):
    """Sums of some 1e-7 of either sign are 0 in the query, and were -0 in the SQL of v8_random_projection."""
    _same_bits(spark, tmp_path, "v8_random_projection", {
        "orders": spark.createDataFrame([(1, 1), (2, 2)], "o_orderkey long, o_custkey long"),
        "lineitem": spark.createDataFrame([(1, 1, 1e-6), (2, 2, 3.0)], "l_orderkey long, l_partkey long, l_quantity double"),
        "part": spark.createDataFrame([(1, "Brand#1", "A"), (2, "Brand#2", "B")], "p_partkey long, p_brand string, p_type string")})


def _tiny(spark):
    """Vectors of two sequences with components, and means of them, just under zero."""
    v = [[-1e-7, 0.5, 0.25], [-2e-7, 0.5, -0.5], [0.125, -1e-7, 0.0]]
    return {"embeddings": spark.createDataFrame([(i, v[i % 3], 0) for i in (*range(2), *range(97, 100))], "vec_id long, embedding array<float>, label int")}


def test_unit_vectors_that_round_to_zero(spark, tmp_path):
    _same_bits(spark, tmp_path, "v9_l2_normalize", _tiny(spark))


def test_mean_pools_that_round_to_zero(spark, tmp_path):
    _same_bits(spark, tmp_path, "t9_mean_pool", _tiny(spark))


def test_pools_that_round_to_zero(spark, tmp_path):
    _same_bits(spark, tmp_path, "t10_pool_tokens", _tiny(spark))


def test_masks_are_made_inside_rows(spark):
    """No row a token and no shuffle; empty cells and cells of special tokens alone keep theirs."""
    df = spark.createDataFrame([("a", [1, *range(3, 40), 2]), ("b", [1, 2]), ("c", [])], "cell_id string, input_ids array<int>")
    out = T.mask_tokens(df, 0.15, 0, -2, 3, 150)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {r["cell_id"]: (r["input_ids"], r["labels"]) for r in out.collect()}
    assert sum(x != -100 for x in got["a"][1]) == 6 and all(t == o for t, o, h in zip(got["a"][0], df.first()["input_ids"], got["a"][1], strict=True) if h == -100)
    assert got["b"] == ([1, 2], [-100, -100]) and got["c"] == ([], [])
