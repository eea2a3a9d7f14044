"""N*, M*, A* and K*: neighbours, embedding metrics, patient tables, classifiers and scores."""

from pyspark.sql import functions as F

from ..functions.columns import r6

from ..operators import classify as K
from ..operators import embed_metrics as M
from ..operators import features as V
from ..operators import graph as N
from ..operators import patient as PT
from ..operators import splits as P
from ..operators.descent import knn_descent
from ..plans import adapters as A
from ..plans.adapters import CELLS, EMB, EXPR, METRICS, PREDS, query
from ..plans.storage import written
from .cell_queries import NORM
from .feature_queries import _PB, _patients

#: Cosine and euclidean distances of all pairs, rounded, and the nearest others.
_DIST = """pr AS (SELECT a.cell_id AS i, b.cell_id AS j, a.label AS la, b.label AS lb, a.batch AS ba, b.batch AS bb,
  round(1 - list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))), 6) AS distance FROM emb a JOIN emb b ON a.cell_id <> b.cell_id)"""
_KNN = f"{EMB}, {_DIST}, knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY distance, j) AS INTEGER) AS rank FROM pr QUALIFY rank <= 14)"
_EUC = """eu AS (SELECT a.cell_id AS i, a.label AS la, b.label AS lb, a.batch AS ba, b.batch AS bb, list_distance(a.embedding, b.embedding) AS d FROM emb a JOIN emb b ON a.cell_id <> b.cell_id)"""


def _edges(s, d):
    return N.knn(A.embeddings(s, d), 15)


@query("n1_knn", f"WITH {_KNN} SELECT i, j, rank, distance + 0.0 AS distance FROM knn")
def n1(s, d):
    return _edges(s, d).select("i", "j", "rank", "distance")


@query("n1_knn_euclidean", f"WITH {EMB}, pr AS (SELECT a.cell_id AS i, b.cell_id AS j, round(list_distance(a.embedding, b.embedding), 6) AS distance FROM emb a JOIN emb b ON a.cell_id <> b.cell_id) SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY distance, j) AS INTEGER) AS rank FROM pr QUALIFY rank <= 4")
def n1b(s, d):
    return N.knn(A.embeddings(s, d), 5, "euclidean").select("i", "j", "rank", "distance")


@query("n2_knn_approx")
def n2(s, d):
    e = A.embeddings(s, d)
    found, figures = knn_descent(e, 15)
    return N.recall(found, N.knn(e, 15, "euclidean")).select(r6("recall").alias("recall"), *[F.lit(round(x, 6)).alias(c) for c, x in figures.items()])


@query("n3_connectivities")
def n3(s, d):
    return N.connectivities(_edges(s, d)).withColumn("weight", r6("weight"))


@query("n4_neighbor_arrays", f"WITH {_KNN} SELECT i, list(j ORDER BY distance, j) AS neighbors, list(distance ORDER BY distance, j) AS distances FROM knn GROUP BY 1")
def n4(s, d):
    return N.neighbors_to_arrays(_edges(s, d))


@query("n5_communities")
def n5(s, d):
    return N.communities(N.connectivities(_edges(s, d)), 0.3)


_CC = f"""{_KNN}, inn AS (SELECT i, j FROM knn WHERE la = lb), lk AS (SELECT i, j FROM inn UNION SELECT j, i FROM inn), rc AS (SELECT cell_id AS a, cell_id AS b FROM emb UNION SELECT rc.a, lk.j FROM rc JOIN lk ON rc.b = lk.i),
  cc AS (SELECT a AS cell_id, min(b) AS component FROM rc GROUP BY 1)"""


@query("n6_components", f"WITH RECURSIVE {_CC} SELECT cc.cell_id, component, label FROM cc JOIN emb USING (cell_id)")
def n6(s, d):
    return N.components_within(_edges(s, d), A.embeddings(s, d))


_ROLES = "rl AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(cell_id || ':0'), cell_id) <= least(greatest(round(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE), 1), count(*) OVER (PARTITION BY label) - 1) THEN 'test' ELSE 'train' END AS role FROM emb)"
_KC = f"""{EMB}, {_ROLES}, pd AS (SELECT a.cell_id, a.label, b.label AS vote, b.cell_id AS j, round(1 - list_inner_product(a.embedding, b.embedding) / (sqrt(list_inner_product(a.embedding, a.embedding)) * sqrt(list_inner_product(b.embedding, b.embedding))), 6) AS d FROM rl a JOIN rl b ON a.role = 'test' AND b.role = 'train'),
  nn AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, j) AS r, min(d) OVER (PARTITION BY cell_id) AS least_d FROM pd QUALIFY r <= 15), vt AS (SELECT cell_id, label, vote, round(sum(CASE WHEN least_d = 0 THEN CAST(d = 0 AS DOUBLE) ELSE 1 / d END), 6) AS w FROM nn GROUP BY ALL),
  kc AS (SELECT cell_id, label, vote AS pred FROM vt QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY w DESC, vote) = 1)"""


@query("n7_knn_classify", f"WITH {_KC} SELECT cell_id, label, pred FROM kc")
def n7(s, d):
    return M.knn_predictions(A.embeddings(s, d)).select("cell_id", "label", "pred")


@query("n8_attach_cluster", f"WITH {CELLS} SELECT cells.*, CASE WHEN c_custkey % 3 <> 0 THEN 'C' || (c_custkey % 4) END AS cluster FROM cells JOIN customer ON cell_id = CAST(c_custkey AS VARCHAR)")
def n8(s, d):
    k = F.col("c_custkey")
    clusters = A.read(s, d, "customer").where(k % 3 != 0).select(k.cast("string").alias("cell_id"), F.concat(F.lit("C"), k % 4).alias("cluster"))
    return N.attach_cluster(A.cells(s, d), clusters)


def _clustered(s, d):
    e = A.embeddings(s, d)
    return e.withColumn("cluster", F.concat(F.lit("K"), F.floor(F.col("embedding")[0] * 8) % 5))


_CL = f"{EMB}, cl AS (SELECT *, 'K' || CAST(floor(embedding[1] * 8) % 5 AS BIGINT) AS cluster FROM emb)"
_NMI = """ct AS (SELECT cluster AS a, label AS b, count(*)::DOUBLE AS n FROM cl GROUP BY ALL), cw AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM ct),
  nm AS (SELECT 2 * sum(n / t * ln(n * t / (na * nb))) / (sum(-n / t * ln(na / t)) + sum(-n / t * ln(nb / t))) AS nmi FROM cw)"""
_ARI = """pc AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS s, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct GROUP BY a)) AS pa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM ct GROUP BY b)) AS pb, (SELECT sum(n) FROM ct) AS n),
  ar AS (SELECT (s - pa * pb / (n * (n - 1) / 2)) / (0.5::DOUBLE * (pa + pb) - pa * pb / (n * (n - 1) / 2)) AS ari FROM pc)"""


def _sil(cat: str, other: str, within: str = "") -> str:
    w, g = ("WHERE la = lb", "la, ") if within else ("", "")
    return f"""sm AS (SELECT i, {g}{cat} AS own, {other} AS other, sum(d) AS d, count(*) AS n FROM eu {w} GROUP BY ALL), ab AS (SELECT i, {g}own, max(CASE WHEN own = other THEN d / n END) AS a, min(CASE WHEN own <> other THEN d / n END) AS b FROM sm GROUP BY ALL),
  ss AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query("m1_nmi", f"WITH {_CL}, {_NMI} SELECT round(nmi, 6) AS nmi FROM nm")
def m1(s, d):
    return M.nmi(_clustered(s, d), "cluster", "label").select(r6("nmi").alias("nmi"))


@query("m2_ari", f"WITH {_CL}, {_NMI}, {_ARI} SELECT round(ari, 6) AS ari FROM ar")
def m2(s, d):
    return M.ari(_clustered(s, d), "cluster", "label").select(r6("ari").alias("ari"))


@query("m3_silhouette_label", f"WITH {EMB}, {_EUC}, {_sil('la', 'lb')} SELECT round((avg(s) + 1) / 2, 6) AS silhouette FROM ss")
def m3(s, d):
    return M.silhouette(A.embeddings(s, d), "label").select(r6("silhouette").alias("silhouette"))


@query("m3_silhouette_batch", f"WITH {EMB}, {_EUC}, {_sil('ba', 'bb')} SELECT round((avg(s) + 1) / 2, 6) AS silhouette FROM ss")
def m3b(s, d):
    return M.silhouette(A.embeddings(s, d), "batch").select(r6("silhouette").alias("silhouette"))


@query("m4_batch_asw", f"WITH {EMB}, {_EUC}, {_sil('ba', 'bb', 'label')}, pl AS (SELECT la, avg(1 - abs(s)) AS v FROM ss GROUP BY 1 HAVING count(DISTINCT own) > 1 AND count(DISTINCT own) < count(*)) SELECT round(avg(v), 6) AS batch_asw FROM pl")
def m4(s, d):
    return M.batch_asw(A.embeddings(s, d)).select(r6("batch_asw").alias("batch_asw"))


@query("m5_graph_connectivity", f"WITH RECURSIVE {_CC}, cs AS (SELECT label, component, count(*) AS n FROM cc JOIN emb USING (cell_id) GROUP BY ALL), sh AS (SELECT label, max(n) / sum(n) AS s FROM cs GROUP BY 1) SELECT round(avg(s), 6) AS graph_connectivity FROM sh")
def m5(s, d):
    return M.graph_connectivity(_edges(s, d), A.embeddings(s, d)).select(r6("graph_connectivity").alias("graph_connectivity"))


@query("m6_pcr")
def m6(s, d):
    return M.pcr(A.embeddings(s, d), "batch", 20).select(r6("pcr").alias("pcr"))


@query("m7_ilisi")
def m7(s, d):
    e = A.embeddings(s, d)
    return M.lisi(_edges(s, d), e, "batch", "i").select(r6("ilisi").alias("ilisi"))


@query("m7_clisi")
def m7b(s, d):
    e = A.embeddings(s, d)
    return M.lisi(_edges(s, d), e, "label", "c").select(r6("clisi").alias("clisi"))


_KB = f"""{EMB}, {_DIST}, kn AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS r FROM pr WHERE la = lb QUALIFY r <= 14), ob AS (SELECT la AS label, i, bb AS b, count(*) AS o FROM kn GROUP BY ALL), sz AS (SELECT la AS label, i, count(*) AS k FROM kn GROUP BY ALL),
  f0 AS (SELECT label, batch AS b, count(*) AS n FROM emb GROUP BY ALL), f1 AS (SELECT label, b, n / sum(n) OVER (PARTITION BY label) AS f, count(*) OVER (PARTITION BY label) AS nb FROM f0), fr AS (SELECT * FROM f1 WHERE nb > 1)"""


@query("m8_kbet_statistic", f"WITH {_KB} SELECT sz.label, sz.i, round(sum((coalesce(o, 0) - k * f) ** 2 / (k * f)), 6) AS chi2, max(nb) - 1 AS df FROM sz JOIN fr USING (label) LEFT JOIN ob ON ob.label = sz.label AND ob.i = sz.i AND ob.b = fr.b GROUP BY ALL")
def m8(s, d):
    return M.kbet_statistic(A.embeddings(s, d)).withColumn("chi2", r6("chi2"))


@query("m8_kbet")
def m8b(s, d):
    return M.kbet_per_label(A.embeddings(s, d)).select(r6("kbet").alias("kbet"))


@query("m8_kbet_diffused")
def m8c(s, d):
    return M.kbet_per_label(A.embeddings(s, d), diffused=True).select(r6("kbet").alias("kbet"))


@query("m9_knn_purity_label", f"WITH {_KNN}, p AS (SELECT i, avg(CAST(la = lb AS INTEGER)) AS s FROM knn GROUP BY 1) SELECT round(avg(s), 6) AS purity FROM p")
def m9(s, d):
    return M.knn_purity(_edges(s, d), A.embeddings(s, d), "label").select(r6("purity").alias("purity"))


@query("m9_knn_purity_batch", f"WITH {_KNN}, p AS (SELECT i, avg(CAST(ba = bb AS INTEGER)) AS s FROM knn GROUP BY 1) SELECT round(avg(s), 6) AS purity FROM p")
def m9b(s, d):
    return M.knn_purity(_edges(s, d), A.embeddings(s, d), "batch").select(r6("purity").alias("purity"))


def _macro(src: str, by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"""sd AS (SELECT {g}label AS c, CAST(label = pred AS INTEGER) AS tp, 0 AS p, 1 AS s FROM {src} UNION ALL SELECT {g}pred, 0, 1, 0 FROM {src}), tb AS (SELECT {g}c, sum(tp) AS tp, sum(p) AS np, sum(s) AS s FROM sd GROUP BY ALL),
  pf AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN s > 0 THEN tp / s ELSE 0 END AS recall, CASE WHEN tp > 0 THEN 2 * tp / (np + s) ELSE 0 END AS f1 FROM tb)"""


_MACRO = "round(sum(tp) / sum(s), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1"
_R4 = ("accuracy", "precision", "recall", "f1")


@query("m10_knn_label_scores", f"WITH {_KC}, {_macro('kc')} SELECT {_MACRO} FROM pf")
def m10(s, d):
    return M.knn_label_scores(A.embeddings(s, d)).withColumns({c: r6(c) for c in _R4})


@query("m11_batch_pred_acc", f"WITH {EMB.replace("'B' || (vec_id % 4) AS batch", "0 AS z").replace("'L' || label AS label", "'B' || (vec_id % 4) AS label")}, {_KC.split(', rl AS', 1)[1].join(('rl AS', ''))} SELECT round(avg(CAST(label = pred AS INTEGER)), 6) AS batch_pred_acc FROM kc")
def m11(s, d):
    return M.batch_pred_acc(A.embeddings(s, d)).select(r6("batch_pred_acc").alias("batch_pred_acc"))


@query("m12_avg_bio", f"WITH {_CL}, {_NMI}, {_ARI}, {_EUC}, {_sil('la', 'lb')} SELECT round((any_value(nmi) + any_value(ari) + (avg(s) + 1) / 2) / 3, 6) AS avg_bio FROM nm, ar, ss")
def m12(s, d):
    c = _clustered(s, d)
    return M.avg_bio(M.nmi(c, "cluster", "label"), M.ari(c, "cluster", "label"), M.silhouette(c, "label")).select(r6("avg_bio").alias("avg_bio"))


@query("m13_embedding_suite")
def m13(s, d):
    return M.embedding_suite(A.embeddings(s, d)).withColumn("value", r6("value"))


@query("m14_subsampled_suite")
def m14(s, d):
    return M.embedding_suite(P.sample_stratified(A.embeddings(s, d), 10_000, "batch", 42)).withColumn("value", r6("value"))


def _bootstrap(s, d):
    return M.bootstrap_suite(A.embeddings(s, d), 10, 10_000, "batch", 42)


@query("m15_bootstrap_suite")
def m15(s, d):
    return M.bootstrap_summary(_bootstrap(s, d)).withColumns({c: r6(c) for c in ("mean", "sd", "median")})


@query("m15_bootstrap_runs")
def m15b(s, d):
    return _bootstrap(s, d).withColumn("value", r6("value"))


@query("m16_benchmark")
def m16(s, d):
    e = written(A.embeddings(s, d))
    keyed = lambda x, name: x.select(F.lit(name).alias("key"), "cell_id", "embedding", "batch", "label")
    return M.benchmark(keyed(e, "whole").unionByName(keyed(V.pca_embedding(e, 16), "pca16"))).withColumn("value", r6("value"))


# --- patients ---

_EMBS = f"{CELLS}, {EMB}, es AS (SELECT sample_id, embedding, cells.cell_id, cells.label, cell_type FROM emb JOIN cells ON cells.cell_id = emb.cell_id)"


@query("a1_mean_embedding", f"WITH {_EMBS}, x AS (SELECT sample_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM es), m AS (SELECT sample_id, dim, round(avg(v), 6) AS v FROM x GROUP BY ALL) SELECT sample_id, list(v ORDER BY dim) AS embedding FROM m GROUP BY 1")
def a1(s, d):
    return PT.mean_embedding(A.embeddings(s, d), A.cells(s, d))


@query("a2_pseudobulk", f"WITH {_PB} SELECT sample_id, gene_id, round(mean, 6) AS mean FROM pb")
def a2(s, d):
    return PT.pseudobulk(A.expr(s, d), A.cells(s, d)).withColumn("mean", r6("mean"))


_TYPES = [f"T{i}" for i in range(6)]


@query("a3_composition", f"WITH {CELLS} SELECT sample_id, {', '.join(f'''count(*) FILTER (cell_type = '{t}') / count(*) AS {t}''' for t in _TYPES)} FROM cells GROUP BY 1")
def a3(s, d):
    return PT.composition(A.cells(s, d))


@query("a4_vote", f"WITH {PREDS}, v AS (SELECT sample_id, pred, count(*) AS n FROM preds GROUP BY ALL) SELECT p.sample_id, (SELECT pred FROM v WHERE v.sample_id = p.sample_id ORDER BY n DESC, pred LIMIT 1) AS pred, round(avg(pred_score), 6) AS pred_score, min(label) AS label FROM preds p GROUP BY p.sample_id")
def a4(s, d):
    return PT.vote(A.predictions(s, d)).withColumn("pred_score", r6("pred_score"))


@query("a5_prob_average", f"WITH {PREDS} SELECT sample_id, round(avg(pred_score), 6) AS pred_score, min(label) AS label, CAST(round(avg(pred_score), 9) > 0.5 AS INTEGER) AS pred FROM preds GROUP BY 1")
def a5(s, d):
    return PT.prob_average(A.predictions(s, d)).withColumn("pred_score", r6("pred_score"))


@query("a6_vote_share", f"WITH {PREDS}, v AS (SELECT sample_id, pred, count(*) AS n FROM preds GROUP BY ALL) SELECT sample_id, max(n) / sum(n) AS share FROM v GROUP BY 1")
def a6(s, d):
    return PT.vote_share(A.predictions(s, d))


_ATT = """lg AS (SELECT sample_id, cell_id, cell_type, label, score / 2000 AS logit, score / 1000 AS sc FROM cells), mx AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY sample_id)) / 0.7::DOUBLE) AS e FROM lg), att AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id) AS attn FROM mx)"""


def _logits(s, d):
    return A.cells(s, d).select("sample_id", "cell_id", "cell_type", "label", (F.col("score") / 2000).alias("logit"), (F.col("score") / 1000).alias("score"))


@query("a7_attention_pool", f"WITH {CELLS}, {EMB}, lg AS (SELECT sample_id, cells.cell_id, embedding, score / 2000 AS logit FROM cells JOIN emb ON emb.cell_id = cells.cell_id), mx AS (SELECT *, exp((logit - max(logit) OVER (PARTITION BY sample_id)) / 0.7::DOUBLE) AS e FROM lg), att AS (SELECT *, e / sum(e) OVER (PARTITION BY sample_id) AS attn FROM mx), x AS (SELECT sample_id, attn, unnest(embedding) AS v, unnest(range(len(embedding))) AS dim FROM att), m AS (SELECT sample_id, dim, round(sum(attn * v), 6) AS v FROM x GROUP BY ALL) SELECT sample_id, list(v ORDER BY dim) AS embedding FROM m GROUP BY 1")
def a7(s, d):
    e = A.embeddings(s, d)
    return PT.attention_pool(e, _logits(s, d).join(e.select("cell_id"), "cell_id"), "sample_id", 0.7)


def _frame(s, d):
    return PT.attention_frame(PT.attention(_logits(s, d), "sample_id", 0.7), "sample_id", 10)


_FRAME = f"{CELLS}, {_ATT}, fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY round(attn, 9) DESC, cell_id) AS INTEGER) AS rank, attn * sc AS contrib, sum(-attn * ln(attn)) OVER (PARTITION BY sample_id) / ln(count(*) OVER (PARTITION BY sample_id)) AS entropy, count(*) OVER (PARTITION BY sample_id) AS n_cells FROM att)"


@query("a8_attention_frame", f"WITH {_FRAME} SELECT sample_id, cell_id, rank, round(attn, 6) AS attn, round(contrib, 6) AS contrib, round(entropy, 6) AS entropy, n_cells, CAST(rank <= 10 AS INTEGER) AS is_topk FROM fr")
def a8(s, d):
    return _frame(s, d).select("sample_id", "cell_id", "rank", r6("attn").alias("attn"), r6("contrib").alias("contrib"), r6("entropy").alias("entropy"), "n_cells", "is_topk")


@query("a9_attention_by_type", f"WITH {_FRAME} SELECT label, {', '.join(f'''coalesce(round(avg(attn) FILTER (cell_type = '{t}'), 6), 0) AS {t}''' for t in _TYPES)} FROM fr GROUP BY 1")
def a9(s, d):
    return PT.attention_by_type(_frame(s, d), _TYPES)


@query("a10_top_type", f"WITH {_FRAME}, t AS (SELECT sample_id, cell_type, round(sum(attn), 6) AS attn FROM fr WHERE rank <= 10 GROUP BY ALL) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY attn DESC, cell_type) = 1")
def a10(s, d):
    return PT.top_type(_frame(s, d), "sample_id")


@query("a11_bag_table", f"WITH {_FRAME} SELECT sample_id, round(max(entropy), 6) AS bag_entropy, max(n_cells) AS n_cells, max(label) AS label FROM fr GROUP BY 1")
def a11(s, d):
    return PT.bag_table(_frame(s, d), "sample_id").withColumn("bag_entropy", r6("bag_entropy"))


@query("a12_marker_table", f"""WITH {NORM}, {CELLS}, mk AS (SELECT DISTINCT p_brand || '/' || p_type AS gene_id FROM part WHERE p_brand = 'Brand#11' UNION SELECT 'absent'), sz AS (SELECT batch, count(*) AS n FROM cells GROUP BY 1), x AS (SELECT batch, gene_id, sum(value) AS s, count(*) FILTER (value > 0) AS k FROM logn JOIN cells USING (cell_id) GROUP BY ALL),
  gd AS (SELECT gene_id, batch, coalesce(s, 0) / n AS mean, coalesce(k, 0) / n AS detected FROM (SELECT gene_id FROM mk WHERE gene_id IN (SELECT gene_id FROM expr)) CROSS JOIN sz LEFT JOIN x USING (gene_id, batch)), sc AS (SELECT *, CASE WHEN max(mean) OVER w > min(mean) OVER w THEN (mean - min(mean) OVER w) / (max(mean) OVER w - min(mean) OVER w) ELSE 0 END AS scaled FROM gd WINDOW w AS (PARTITION BY gene_id))
  SELECT gene_id, batch AS cluster, round(mean, 6) AS mean, round(detected, 6) AS detected, round(scaled, 6) AS scaled FROM mk LEFT JOIN sc USING (gene_id)""")
def a12(s, d):
    from ..operators import qc as Q

    part = A.read(s, d, "part").where("p_brand = 'Brand#11'").select(F.concat("p_brand", F.lit("/"), "p_type").alias("gene_id")).distinct()
    markers = part.union(s.createDataFrame([("absent",)], "gene_id string"))
    x = Q.log1p(Q.normalize_total(A.expr(s, d)))
    return PT.marker_table(x, A.cells(s, d).select("cell_id", F.col("batch").alias("cluster")), markers).withColumns({c: r6(c) for c in ("mean", "detected", "scaled")})


# --- classifiers and scores ---


def _patient_vectors(s, d):
    """Each sample's mean of its cells' embeddings."""
    e = A.embeddings(s, d).select("cell_id", "embedding")
    c = A.cells(s, d)
    return e, c, PT.mean_embedding(e, c).join(_patients(s, d).select("sample_id", "label"), "sample_id")


@query("k1_make_classifier")
def k1(s, d):
    x = written(_patient_vectors(s, d)[2])
    out = None
    for name in ("logistic_regression", "svc", "no such name"):
        p = K.fit_score(x, x, name, {"n_estimators": 10}).where("role = 'test'").select(F.lit(name).alias("model"), "sample_id", "label", "pred")
        out = p if out is None else out.unionByName(p)
    return out


@query("k2_fit_score")
def k2(s, d):
    x = written(P.train_test_split(_patient_vectors(s, d)[2], 0.3, 5))
    return K.fit_score(x.where("role = 'train'").drop("role"), x.where("role = 'test'").drop("role"), "logistic_regression").withColumn("pred_score", r6("pred_score"))


@query("k3_cross_validate")
def k3(s, d):
    e, c, _ = _patient_vectors(s, d)
    roles = P.kfold_roles(P.stratified_kfold(_patients(s, d), 3, 11))
    return K.cross_validate(e, c, roles, "logistic_regression", {"C": 1.0}).withColumn("pred_score", r6("pred_score"))


@query("k4_macro_scores", f"WITH {PREDS}, {_macro('preds', 'run_id')} SELECT run_id, {_MACRO} FROM pf GROUP BY 1")
def k4(s, d):
    return K.macro_scores(A.predictions(s, d), ["run_id"]).withColumns({c: r6(c) for c in _R4})


@query("k5_roc_auc", f"""WITH {PREDS}, r AS (SELECT run_id, label, rank() OVER w + (count(*) OVER (PARTITION BY run_id, pred_score) - 1) / 2 AS r FROM preds WINDOW w AS (PARTITION BY run_id ORDER BY pred_score)), s AS (SELECT run_id, sum(r) FILTER (label = 1) AS r, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM r GROUP BY 1)
  SELECT run_id, round((r - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS roc_auc FROM s""")
def k5(s, d):
    return K.roc_auc(A.predictions(s, d), ["run_id"]).withColumn("roc_auc", r6("roc_auc"))


#: Cells scored for each of the ten labels by a value of their vectors.
_OVR = f"""{EMB}, ps AS (SELECT batch, label, 'L' || c AS class, round(embedding[c + 1], 2) AS pred_score FROM emb, (SELECT unnest(range(10)) AS c)), b AS (SELECT batch, class, CAST(label = class AS INTEGER) AS label, pred_score FROM ps)"""
_TEN = [f"L{c}" for c in range(10)]


def _class_scores(s, d):
    return A.embeddings(s, d).select("batch", "label", F.transform(F.slice("embedding", 1, 10), lambda x: F.round(x, 2)).alias("pred_scores"))


@query("k5_roc_auc_ovr", f"""WITH {_OVR}, r AS (SELECT batch, class, label, rank() OVER (PARTITION BY batch, class ORDER BY pred_score) + (count(*) OVER (PARTITION BY batch, class, pred_score) - 1) / 2 AS r FROM b), s AS (SELECT batch, class, sum(r) FILTER (label = 1) AS r, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM r GROUP BY ALL),
  a AS (SELECT batch, CASE WHEN n1 > 0 AND n0 > 0 THEN (r - n1 * (n1 + 1) / 2) / (n1 * n0) END AS v FROM s) SELECT batch, CASE WHEN count(v) = count(*) THEN round(avg(v), 6) END AS roc_auc FROM a GROUP BY 1""")
def k5b(s, d):
    return K.roc_auc(_class_scores(s, d), ["batch"], _TEN).withColumn("roc_auc", r6("roc_auc"))


@query("k6_average_precision_ovr", f"""WITH {_OVR}, th AS (SELECT batch, class, pred_score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM b GROUP BY ALL), cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY batch, class) AS n1 FROM th WINDOW w AS (PARTITION BY batch, class ORDER BY pred_score DESC)),
  a AS (SELECT batch, class, sum(CASE WHEN n1 > 0 THEN pos / n1 * tp / (tp + fp) END) AS v FROM cv GROUP BY ALL) SELECT batch, CASE WHEN count(v) = count(*) THEN round(avg(v), 6) END AS average_precision FROM a GROUP BY 1""")
def k6b(s, d):
    return K.average_precision(_class_scores(s, d), ["batch"], _TEN).withColumn("average_precision", r6("average_precision"))


_CURVE = """th AS (SELECT run_id, pred_score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM preds GROUP BY ALL), cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY run_id) AS n1, sum(neg) OVER (PARTITION BY run_id) AS n0 FROM th WINDOW w AS (PARTITION BY run_id ORDER BY pred_score DESC))"""


@query("k6_average_precision", f"WITH {PREDS}, {_CURVE} SELECT run_id, round(sum(pos / n1 * tp / (tp + fp)), 6) AS average_precision FROM cv GROUP BY 1")
def k6(s, d):
    return K.average_precision(A.predictions(s, d), ["run_id"]).withColumn("average_precision", r6("average_precision"))


@query("k7_class_report", f"""WITH {PREDS}, {_macro('preds')}, al AS (SELECT c, coalesce(s, 0) AS s, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1 FROM (SELECT unnest([0, 1, 2]) AS c) LEFT JOIN pf USING (c))
  SELECT CAST(c AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(s AS BIGINT) AS support FROM al UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(s) AS BIGINT) FROM al
  UNION ALL SELECT 'weighted avg', round(sum(precision * s) / sum(s), 6), round(sum(recall * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM al""")
def k7(s, d):
    return K.class_report(A.predictions(s, d), [0, 1, 2]).withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("k8_confusion", f"WITH {PREDS} SELECT label, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM preds GROUP BY label, pred")
def k8(s, d):
    return K.confusion(A.predictions(s, d), True).withColumn("share", r6("share"))


@query("k9_roc_points", f"WITH {PREDS}, {_CURVE} SELECT run_id, pred_score, round(fp / n0, 6) AS fpr, round(tp / n1, 6) AS tpr FROM cv")
def k9(s, d):
    return K.roc_points(A.predictions(s, d), ["run_id"]).withColumns({c: r6(c) for c in ("fpr", "tpr")})


@query("k9_pr_points", f"WITH {PREDS}, {_CURVE} SELECT run_id, pred_score, round(tp / (tp + fp), 6) AS precision, round(tp / n1, 6) AS recall FROM cv")
def k9b(s, d):
    return K.pr_points(A.predictions(s, d), ["run_id"]).withColumns({c: r6(c) for c in ("precision", "recall")})


@query("k10_learning_curve")
def k10(s, d):
    x = written(_patient_vectors(s, d)[2])
    return K.learning_curve(x, K.curve_sizes(x.count(), 5), 5, params={"C": 1.0}).withColumns({c: r6(c) for c in ("mean", "sd")})


@query("k11_baseline_oof")
def k11(s, d):
    return K.baseline_oof(_patient_vectors(s, d)[2], 3, params={"C": 1.0}).withColumn("pred_score", r6("pred_score"))


@query("k12_log_loss", f"WITH {PREDS} SELECT run_id, round(avg(-ln(CASE WHEN label = 1 THEN least(greatest(pred_score, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(pred_score, 1e-15), 1 - 1e-15) END)), 6) AS log_loss FROM preds GROUP BY 1")
def k12(s, d):
    return K.log_loss(A.predictions(s, d), ["run_id"]).withColumn("log_loss", r6("log_loss"))


@query("k12_bce_logits", f"WITH {PREDS}, z AS (SELECT label, 8 * pred_score - 4 AS z FROM preds) SELECT round(avg(CASE WHEN label = 1 THEN 0.4 * (greatest(-z, 0) + ln(1 + exp(-abs(z)))) ELSE greatest(z, 0) + ln(1 + exp(-abs(z))) END), 6) AS bce FROM z")
def k12b(s, d):
    return K.bce_logits(A.predictions(s, d).withColumn("logit", 8 * F.col("pred_score") - 4), 0.4).select(r6("bce").alias("bce"))


_HIST = f"""{METRICS}, h AS (SELECT run_id, fold AS epoch, round(avg(value), 4) AS loss FROM metrics GROUP BY ALL)"""


@query("k13_early_stop", f"""WITH RECURSIVE {_HIST}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS r FROM h),
  st AS (SELECT run_id, CAST(0 AS BIGINT) AS r, CAST('inf' AS DOUBLE) AS best, CAST(-1 AS BIGINT) AS "at", 0 AS wait, CAST(NULL AS BIGINT) AS stopped FROM (SELECT DISTINCT run_id FROM o)
    UNION ALL SELECT o.run_id, o.r, CASE WHEN st.stopped IS NULL AND loss < best - 1 THEN loss ELSE best END, CASE WHEN st.stopped IS NULL AND loss < best - 1 THEN epoch ELSE "at" END, CASE WHEN st.stopped IS NOT NULL THEN wait WHEN loss < best - 1 THEN 0 ELSE wait + 1 END,
      CASE WHEN st.stopped IS NOT NULL THEN st.stopped WHEN loss >= best - 1 AND wait + 1 >= 2 THEN epoch END FROM st JOIN o ON o.run_id = st.run_id AND o.r = st.r + 1)
  SELECT run_id, "at" AS best_epoch, best AS best_loss, stopped AS stopped_epoch FROM st QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY r DESC) = 1""")
def k13(s, d):
    h = A.metrics(s, d).groupBy("run_id", F.col("fold").alias("epoch")).agg(F.round(F.avg("value"), 4).alias("loss"))
    return K.early_stop(h, 1.0, 2)
