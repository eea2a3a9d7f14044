"""Every registered query against its SQL in DuckDB; those without SQL run and give rows."""

import pytest
from compare import plain, rows, same

from skarn.catalog import oracle_sql, queries

QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = duck.execute(SQL[name])
    found = [d[0] for d in cur.description]
    assert sorted(found) == cols
    want = sorted((tuple(plain(r[found.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    got = rows(df)
    assert len(got) == len(want)
    assert all(map(same, got, want)), [(a, b) for a, b in zip(got, want, strict=True) if not same(a, b)][:3]


@pytest.mark.parametrize("name", ["v4_hvg_v3", "v6_pca", "v7_svd", "n2_knn_approx", "n3_connectivities", "m7_ilisi", "m8_kbet", "r14_wilcoxon_p", "k2_fit_score"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
