"""Hand-computed answers and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from skarn.functions.columns import ensembl_stable
from skarn.functions.special import beta_i, gamma_q, signed_rank_p
from skarn.operators import classify as K
from skarn.operators import embed_metrics as M
from skarn.operators import features as V
from skarn.operators import graph as N
from skarn.operators import patient as PT
from skarn.operators import qc as Q
from skarn.operators import report as R
from skarn.operators import splits as P
from skarn.operators import tokens as T
from skarn.plans import adapters as A


def one(df):
    return df.first()[0]


def test_agreement(spark):
    same = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "u string, v string")
    crossed = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "u string, v string")
    assert one(M.nmi(same, "u", "v")) == pytest.approx(1) and one(M.ari(same, "u", "v")) == pytest.approx(1)
    assert one(M.nmi(crossed, "u", "v")) == pytest.approx(0, abs=1e-12) and one(M.ari(crossed, "u", "v")) == pytest.approx(-0.5)


def test_scores(spark):
    flat = spark.createDataFrame([(0, 0.5), (1, 0.5), (1, 0.5)], "label int, pred_score double")
    assert one(K.roc_auc(flat)) == 0.5 and one(K.average_precision(flat)) == pytest.approx(2 / 3)
    four = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, pred_score double")
    assert one(K.roc_auc(four)) == 0.75 and one(K.average_precision(four)) == pytest.approx(0.833333, abs=1e-6)
    assert one(K.roc_auc(flat.where("label = 1"))) is None


def test_silhouette_on_a_line(spark):
    e = spark.createDataFrame([("a", [0.0], "p"), ("b", [1.0], "p"), ("c", [10.0], "q"), ("d", [11.0], "q")], "cell_id string, embedding array<double>, g string")
    s = {r["i"]: r["s"] for r in M.silhouette_samples(e, "g", block_rows=2).collect()}
    assert s["a"] == pytest.approx(0.904762, abs=1e-6) and s["b"] == pytest.approx(0.894737, abs=1e-6) and s["c"] == pytest.approx(0.894737, abs=1e-6)


def test_benjamini_hochberg(spark):
    t = spark.createDataFrame([("a", "1", 0.01), ("b", "2", 0.04), ("c", "3", 0.03), ("d", "4", 0.005)], "a string, b string, p double")
    assert [round(r["p_adj"], 9) for r in R.bh_adjust(t).orderBy("a").collect()] == [0.02, 0.04, 0.04, 0.02]


def test_normalize_and_attention(spark):
    x = spark.createDataFrame([("c", "g", 1.0), ("c", "h", 3.0)], "cell_id string, gene_id string, value double")
    assert sorted(r["value"] for r in Q.normalize_total(x, 1e4).collect()) == [2500, 7500]
    lg = spark.createDataFrame([("b", "1", 0.3, 1.0), ("b", "2", 0.3, 1.0)], "bag string, cell_id string, logit double, score double")
    f = PT.attention_frame(PT.attention(lg, "bag"), "bag", 1).collect()
    assert {r["attn"] for r in f} == {0.5} and f[0]["entropy"] == pytest.approx(1)


def test_identifiers(spark):
    x = spark.createDataFrame([("ENSG00000237491.8_4",), ("ensmusg00000012345",), ("TP53",), (None,)], "g string")
    assert [r[0] for r in x.select(ensembl_stable("g")).collect()] == ["ENSG00000237491", "ENSMUSG00000012345", None, None]


def test_tails():
    assert gamma_q(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    assert beta_i(5, 0.5, 10 / (10 + 2.2281388519649385**2)) == pytest.approx(0.05, abs=1e-9)
    assert signed_rank_p(0, 5) == 2 / 32 and 0 < signed_rank_p(200, 40) < 1


def test_lisi_counts_even_categories(spark):
    e = spark.createDataFrame([("x", str(i), i + 1, 1.0) for i in range(14)], "i string, j string, rank int, distance double")
    c = spark.createDataFrame([(str(i), "AB"[i % 2]) for i in range(14)] + [("x", "A")], "cell_id string, b string")
    assert one(M.lisi_samples(e, c, "b").select("lisi")) == pytest.approx(2, abs=1e-6)


def test_splits(spark, sf_dir):
    cells = A.cells(spark, sf_dir)
    from skarn.operators.cells import patient_info

    f = P.stratified_kfold(patient_info(cells), 5, 3)
    assert f.count() == f.select("sample_id").distinct().count() == 25 and f.agg(F.max("fold")).first()[0] == 4
    assert P.sample_stratified(cells, 57, "batch", 1).count() == 57
    again = P.sample_stratified(cells.repartition(7), 57, "batch", 1)
    assert {r[0] for r in again.select("cell_id").collect()} == {r[0] for r in P.sample_stratified(cells, 57, "batch", 1).select("cell_id").collect()}
    o = P.oversample(f, 1).groupBy("label").agg(F.sum("multiplicity").alias("n")).collect()
    assert len({r["n"] for r in o}) == 1


def test_knn_whatever_the_blocks(spark, sf_dir):
    e = A.embeddings(spark, sf_dir).limit(120)
    want = sorted(map(tuple, N.knn(e, 6, block_rows=1000).select("i", "j", "rank").collect()))
    for rows in (7, 50):
        assert sorted(map(tuple, N.knn(e, 6, block_rows=rows).select("i", "j", "rank").collect())) == want


def test_pca_is_centred_and_ordered(spark, sf_dir):
    p = V.pca_embedding(A.embeddings(spark, sf_dir), 4).select(*[F.col("embedding")[i].alias(f"c{i}") for i in range(4)])
    m = p.agg(*[F.avg(c).alias(c) for c in p.columns], *[F.var_samp(c).alias(f"v{c}") for c in p.columns]).first()
    assert all(abs(m[c]) < 1e-9 for c in p.columns) and m["vc0"] >= m["vc1"] >= m["vc2"] >= m["vc3"]


def test_scaled_genes_have_unit_deviation(spark, sf_dir):
    z = Q.scale(A.expr(spark, sf_dir), A.cells(spark, sf_dir), 1e9).groupBy("gene_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    assert z.where("abs(m) > 1e-6 or abs(s - 1) > 1e-6").count() == 0


def test_communities_split_two_cliques(spark):
    e = [(a + str(i), a + str(j), 1.0) for a in "xy" for i in range(5) for j in range(5) if i != j] + [("x0", "y0", 0.1), ("y0", "x0", 0.1)]
    edges = spark.createDataFrame(e, "i string, j string, weight double")
    c = N.communities(edges, 1.0, 12)
    assert one(N.modularity(edges, c)) > 0.3


def test_masks_and_pools(spark):
    t = spark.createDataFrame([("c", list(range(10)))], "cell_id string, input_ids array<int>")
    r = T.mask_tokens(t, 0.15, 0, -2, 3, 100).first()
    assert sum(x != -100 for x in r["labels"]) == 2 and all(r["labels"][i] == -100 for i in range(3))
    v = spark.createDataFrame([("c", 0, [1.0, 4.0]), ("c", 1, [3.0, 2.0])], "cell_id string, pos int, vec array<double>")
    assert T.pool_tokens(v, "all").first()["embedding"] == [3.0, 2.0, 1.0, 4.0, 3.0, 4.0, 2.0, 3.0]


def test_early_stopping(spark):
    h = spark.createDataFrame([("r", i, x) for i, x in enumerate([5.0, 4.0, 3.9, 3.95, 2.0])], "run_id string, epoch int, loss double")
    r = K.early_stop(h, 0.5, 2).first()
    assert (r["best_epoch"], r["best_loss"], r["stopped_epoch"]) == (1, 4.0, 3)


def test_wilcoxon(spark):
    p = spark.createDataFrame([("m", float(i), 0.0) for i in range(1, 7)], "g string, x double, y double")
    r = R.wilcoxon_pairs(p, ["g"]).first()
    assert r["w"] == 0 and math.isclose(r["p"], 2 / 64)


def test_gene_panels(spark, tmp_path):
    from skarn.sources.tables import read_gene_panel

    (tmp_path / "p.tsv").write_text("n\tgene\r\n1\tB\r\n2\tA\r\n3\r\n")
    (tmp_path / "p.txt").write_text("# panel\nB,x\n\n A ,y")
    assert [tuple(r) for r in read_gene_panel(spark, f"file://{tmp_path}/p.tsv", "gene").orderBy("pos").collect()] == [("B", 0), ("A", 1), (None, 2)]
    assert [tuple(r) for r in read_gene_panel(spark, f"file://{tmp_path}/p.txt").orderBy("pos").collect()] == [("B", 1), ("A", 3)]
    with pytest.raises(Exception, match="no column g"):
        read_gene_panel(spark, f"file://{tmp_path}/p.tsv", "g").collect()
