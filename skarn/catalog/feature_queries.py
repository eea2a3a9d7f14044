"""V*, T* and P*: variable genes and projections, sequences, samples and splits."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import features as V
from ..operators import patient as PT
from ..operators import qc as Q
from ..operators import splits as P
from ..operators import tokens as T
from ..operators.axes import axes_table
from ..operators.quantiles import quantiles
from ..plans import adapters as A
from ..plans.adapters import CELLS, EMB, EXPR, query
from .cell_queries import NORM

_N = "(SELECT count(*) FROM customer)"


def _disp(source: str, by: str = "", n: str = _N) -> str:
    """Named parts m (moments), z (normalised dispersions) over a long table of raw-scale values."""
    g, p = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    on = f"USING ({by})" if by else "ON true"
    return f"""m AS (SELECT gene_id, {g}sum(value) / {n} AS mean, (sum(value * value) - sum(value) * sum(value) / {n}) / ({n} - 1) AS var FROM {source} GROUP BY ALL),
  d AS (SELECT *, CASE WHEN var > 0 AND mean > 0 THEN ln(var / mean) END AS disp, ln(1 + mean) AS lm FROM m),
  b AS (SELECT *, min(lm) OVER ({p}) AS lo, max(lm) OVER ({p}) AS hi FROM d),
  c AS (SELECT *, CASE WHEN hi > lo THEN greatest(ceil(round((lm - lo) / (hi - lo) * 20, 9)), 1) ELSE 1 END AS bin FROM b),
  z AS (SELECT *, CASE WHEN disp IS NOT NULL THEN round(CASE WHEN count(disp) OVER w = 1 THEN 1 ELSE (disp - avg(disp) OVER w) / stddev_samp(disp) OVER w END, 6) END AS z FROM c WINDOW w AS (PARTITION BY {g}bin))"""


@query("v1_hvg", f"WITH {NORM}, raw AS (SELECT cell_id, gene_id, exp(value) - 1 AS value FROM logn), {_disp('raw')} SELECT gene_id, round(mean, 6) AS mean, round(disp, 6) AS disp, z FROM z WHERE z IS NOT NULL ORDER BY z DESC, gene_id LIMIT 40")
def v1(s, d):
    return V.hvg(Q.log1p(Q.normalize_total(A.expr(s, d))), A.cells(s, d).count(), 40).withColumns({c: r6(c) for c in ("mean", "disp")})


@query("v2_hvg_by_batch", f"""WITH {NORM}, {CELLS}, raw AS (SELECT cell_id, gene_id, batch, n, exp(value) - 1 AS value FROM logn JOIN cells USING (cell_id) JOIN (SELECT batch, count(*) AS n FROM cells GROUP BY 1) USING (batch)), {_disp('raw', 'batch', 'any_value(n)')},
  r AS (SELECT gene_id, z, row_number() OVER (PARTITION BY batch ORDER BY z DESC, gene_id) <= 40 AS chosen FROM z WHERE z IS NOT NULL)
  SELECT gene_id, count(*) FILTER (chosen) AS n_batches, round(avg(z), 6) AS mean_z FROM r GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 40""")
def v2(s, d):
    return V.hvg_by_batch(Q.log1p(Q.normalize_total(A.expr(s, d))), A.cells(s, d), 40)


@query("v3_hvg_normalized", f"WITH {NORM}, raw AS (SELECT cell_id, gene_id, exp(value) - 1 AS value FROM logn), {_disp('raw')}, t AS (SELECT gene_id FROM z WHERE z IS NOT NULL ORDER BY z DESC, gene_id LIMIT 40) SELECT cell_id, gene_id, value FROM expr SEMI JOIN t USING (gene_id)")
def v3(s, d):
    return V.hvg_normalized(A.expr(s, d), A.cells(s, d).count(), 40).select("cell_id", "gene_id", "value")


@query("v4_hvg_v3")
def v4(s, d):
    return V.hvg_v3(A.expr(s, d), A.cells(s, d).count(), 40)


_GENES20 = "g AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS pos FROM (SELECT gene_id FROM expr GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 20))"


def _genes20(s, d):
    return A.expr(s, d).groupBy("gene_id").agg(F.sum("value").alias("t")).orderBy(F.desc("t"), "gene_id").limit(20)


@query("v5_hvg_embedding", f"WITH {EXPR}, g AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) - 1 AS pos FROM (SELECT DISTINCT gene_id FROM expr)) SELECT CAST(c_custkey AS VARCHAR) AS cell_id, list(coalesce(value, 0) ORDER BY pos) AS embedding FROM customer CROSS JOIN g LEFT JOIN expr e ON e.cell_id = CAST(c_custkey AS VARCHAR) AND e.gene_id = g.gene_id GROUP BY 1")
def v5(s, d):
    x = A.expr(s, d)
    return V.hvg_embedding(x, A.cells(s, d), x.select("gene_id"))


@query("v6_pca")
def v6(s, d):
    return V.pca_embedding(A.embeddings(s, d), 10).select("cell_id", F.transform("embedding", r6).alias("embedding"))


@query("v7_svd")
def v7(s, d):
    x = A.expr(s, d)
    return V.svd_genes(x, A.cells(s, d), x.select("gene_id"), 8)[0].select("cell_id", F.transform("embedding", r6).alias("embedding"))


@query("v6_pca_genes")
def v6b(s, d):
    x = A.expr(s, d, "part")
    return V.pca_genes(x, A.cells(s, d), x.select("gene_id"), 8)[0].select("cell_id", F.transform("embedding", r6).alias("embedding"))


@query("v7_svd_axes")
def v7b(s, d):
    x = A.expr(s, d, "part")
    return axes_table(s, V.svd_genes(x, A.cells(s, d), x.select("gene_id"), 8)[1])


_U = lambda tag: f"(CAST('0x' || substr(md5(gene_id || ':' || dim || ':0:{tag}'), 1, 8) AS BIGINT) / 4294967296.0)"


@query("v8_random_projection", f"""WITH {EXPR}, x AS (SELECT cell_id, gene_id, value, unnest(range(16)) AS dim FROM expr), p AS (SELECT cell_id, dim, sum(value * 0.05 * sqrt(-2 * ln(1 - {_U('a')})) * cos(2 * pi() * {_U('b')})) AS x FROM x GROUP BY ALL)
  SELECT cell_id, list(round(x, 6) + 0.0 ORDER BY dim) AS embedding FROM p GROUP BY 1""")
def v8(s, d):
    return V.random_projection(A.expr(s, d)).select("cell_id", F.transform("embedding", r6).alias("embedding"))


@query("v9_l2_normalize", f"WITH {EMB} SELECT cell_id, [round(x / sqrt(list_sum([y * y FOR y IN embedding])), 6) + 0.0 FOR x IN embedding] AS embedding FROM emb")
def v9(s, d):
    return V.l2_normalize(A.embeddings(s, d)).select("cell_id", F.transform("embedding", r6).alias("embedding"))


@query("v10_concat_embeddings", f"WITH {EMB} SELECT cell_id, list_concat(embedding, [2 * x FOR x IN embedding]) AS embedding FROM emb")
def v10(s, d):
    e = A.embeddings(s, d)
    return V.concat_embeddings(e, e.withColumn("embedding", F.transform("embedding", lambda x: 2 * x))).select("cell_id", "embedding")


_PB = f"{EXPR}, {CELLS}, pb AS (SELECT sample_id, gene_id, sum(value) / any_value(n) AS mean FROM expr JOIN cells USING (cell_id) JOIN (SELECT sample_id, count(*) AS n FROM cells GROUP BY 1) USING (sample_id) GROUP BY ALL)"


@query("v11_top_variance", f"""WITH {_PB}, f AS (SELECT s.sample_id, g.gene_id, coalesce(mean, 0) AS value FROM (SELECT DISTINCT sample_id FROM cells) s CROSS JOIN (SELECT DISTINCT gene_id FROM expr) g LEFT JOIN pb ON pb.sample_id = s.sample_id AND pb.gene_id = g.gene_id)
  SELECT gene_id, round(var_samp(value), 6) AS variance FROM f GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def v11(s, d):
    x, c = A.expr(s, d), A.cells(s, d)
    pb = PT.pseudobulk(x, c)
    grid = c.select("sample_id").distinct().crossJoin(x.select("gene_id").distinct())
    return V.top_variance(grid.join(pb, ["sample_id", "gene_id"], "left").select("sample_id", "gene_id", F.coalesce("mean", F.lit(0.0)).alias("value")), 30)


# --- sequences ---

_VOC = "voc AS (SELECT gene_id, CAST(row_number() OVER (ORDER BY gene_id) + 3 AS INTEGER) AS token FROM (SELECT DISTINCT gene_id FROM expr))"


def _vocab(x):
    from pyspark.sql import Window

    return x.select("gene_id").distinct().withColumn("token", (F.row_number().over(Window.orderBy("gene_id")) + 3).cast("int"))


_RANKED = f"""{EXPR}, {_VOC}, med AS (SELECT gene_id, median(value) AS median FROM expr GROUP BY 1), tot AS (SELECT cell_id, sum(value) AS total FROM expr GROUP BY 1),
  s AS (SELECT cell_id, token, round(value / total * 10000 / median, 9) AS score FROM expr JOIN voc USING (gene_id) JOIN med USING (gene_id) JOIN tot USING (cell_id)),
  tok AS (SELECT cell_id, list_concat(list_concat([1::INTEGER], list(token ORDER BY score DESC, token)[:2046]), [2::INTEGER]) AS input_ids FROM s GROUP BY 1)"""


def _tokens(s, d):
    x = A.expr(s, d)
    return T.rank_tokens(x, quantiles(x, "value", [0.5], ["gene_id"]).select("gene_id", F.col("quantiles")[0].alias("median")), _vocab(x), 2048, (1, 2))


@query("t1_rank_tokens", f"WITH {_RANKED} SELECT cell_id, input_ids, CAST(len(input_ids) AS INTEGER) AS length FROM tok")
def t1(s, d):
    return _tokens(s, d)


@query("t2_bin_values", f"""WITH {EXPR}, q AS (SELECT cell_id, gene_id, rank() OVER (PARTITION BY cell_id ORDER BY value) - 1 AS below, count(*) OVER (PARTITION BY cell_id) AS n FROM expr WHERE value > 0)
  SELECT cell_id, gene_id, CAST(1 + len([i FOR i IN range(1, 49) IF i * (n - 1) < 49 * below]) AS INTEGER) AS bin FROM q""")
def t2(s, d):
    return T.bin_values(A.expr(s, d), 51)


@query("t3_tokenize_pad", f"""WITH {EXPR}, {_VOC}, x AS (SELECT cell_id, token, value, row_number() OVER (PARTITION BY cell_id ORDER BY md5(gene_id || ':0'), gene_id) AS nth FROM expr JOIN voc USING (gene_id) WHERE value > 0),
  a AS (SELECT cell_id, list(token ORDER BY token) AS t, list(value ORDER BY token) AS v FROM x WHERE nth <= 2047 GROUP BY 1)
  SELECT cell_id, list_concat(list_concat([0::INTEGER], t), [(-1)::INTEGER FOR i IN range(2047 - len(t))]) AS input_ids, list_concat(list_concat([0::DOUBLE], v), [0::DOUBLE FOR i IN range(2047 - len(v))]) AS values, CAST(len(t) + 1 AS INTEGER) AS length FROM a""")
def t3(s, d):
    x = A.expr(s, d)
    return T.tokenize_pad(x, _vocab(x), 2048, -1, 0)


@query("t4_gather_nonzero", f"""WITH {EXPR}, {_GENES20}, v AS (SELECT CAST(c_custkey AS VARCHAR) AS cell_id, g.pos, coalesce(value, 0) AS value FROM customer CROSS JOIN g LEFT JOIN expr e ON e.cell_id = CAST(c_custkey AS VARCHAR) AND e.gene_id = g.gene_id),
  a AS (SELECT cell_id, coalesce(list(value ORDER BY pos) FILTER (value <> 0), []) AS v, coalesce(list(CAST(pos AS INTEGER) ORDER BY pos) FILTER (value <> 0), []) AS p FROM v GROUP BY 1), n AS (SELECT max(len(v)) AS n FROM a)
  SELECT cell_id, list_concat(v, [0::DOUBLE FOR i IN range(n - len(v))]) AS values, list_concat(p, [(-1)::INTEGER FOR i IN range(n - len(v))]) AS positions, list_concat([0::INTEGER FOR i IN range(len(v))], [1::INTEGER FOR i IN range(n - len(v))]) AS padding FROM a, n""")
def t4(s, d):
    return T.gather_nonzero(V.hvg_embedding(A.expr(s, d), A.cells(s, d), _genes20(s, d)).withColumnRenamed("embedding", "values"))


@query("t5_encode_depth", f"""WITH {EXPR}, tot AS (SELECT cell_id, sum(value) AS total FROM expr GROUP BY 1)
  SELECT cell_id, list_concat(list(round(ln(1 + value / total * 10000), 6) ORDER BY gene_id), [round(log10(any_value(total)) + 4, 6), round(log10(any_value(total)), 6)]) AS values FROM expr JOIN tot USING (cell_id) GROUP BY 1""")
def t5(s, d):
    return T.encode_depth(A.expr(s, d), "a", 4.0)


@query("t6_pad_mask", f"WITH {_RANKED} SELECT cell_id, list_concat(input_ids[:2048], [0::INTEGER FOR i IN range(2048 - len(input_ids[:2048]))]) AS input_ids, list_concat([1::INTEGER FOR i IN range(len(input_ids[:2048]))], [0::INTEGER FOR i IN range(2048 - len(input_ids[:2048]))]) AS attention_mask FROM tok")
def t6(s, d):
    return T.pad_mask(_tokens(s, d), 2048)


@query("t7_mask_tokens", f"""WITH {_RANKED}, x AS (SELECT cell_id, unnest(input_ids) AS tok, CAST(unnest(range(len(input_ids))) AS INTEGER) AS pos FROM tok), k AS (SELECT *, md5(cell_id || ':' || pos || ':0') AS key, tok >= 3 AS plain FROM x),
  h AS (SELECT *, plain AND row_number() OVER (PARTITION BY cell_id, plain ORDER BY key, pos) <= ceil(CAST(0.15 AS DOUBLE) * count(*) FILTER (plain) OVER (PARTITION BY cell_id)) AS hit, CAST('0x' || substr(reverse(key), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM k),
  m AS (SELECT *, CASE WHEN NOT hit THEN tok WHEN u < 0.8 THEN -2 WHEN u < 0.9 THEN CAST(3 + CAST('0x' || substr(key, 9, 6) AS BIGINT) % 150 AS INTEGER) ELSE tok END AS t, CASE WHEN hit THEN tok ELSE -100 END AS l FROM h)
  SELECT cell_id, list(t ORDER BY pos) AS input_ids, list(l ORDER BY pos) AS labels FROM m GROUP BY 1""")
def t7(s, d):
    return T.mask_tokens(_tokens(s, d), 0.15, 0, -2, 3, 150)


@query("t8_make_bags", f"""WITH {_RANKED}, {CELLS}, x AS (SELECT sample_id, cell_id, input_ids, row_number() OVER (PARTITION BY sample_id ORDER BY md5(cell_id || ':0'), cell_id) AS nth FROM tok JOIN cells USING (cell_id))
  SELECT sample_id, CAST(floor((nth - 1) / 500) AS BIGINT) AS bag, list(cell_id ORDER BY nth) AS cells, list(CAST(least(len(input_ids), 512) AS INTEGER) ORDER BY nth) AS lengths FROM x WHERE nth <= 1000 GROUP BY ALL""")
def t8(s, d):
    return T.make_bags(_tokens(s, d), A.cells(s, d), 1000, 500, 512)


_VECS = """vecs AS (SELECT CAST(vec_id // 97 AS VARCHAR) AS cell_id, CAST(vec_id % 97 AS INTEGER) AS pos, [x::DOUBLE FOR x IN embedding] AS vec, CAST(20 + (vec_id // 97) * 37 % 78 AS INTEGER) AS length FROM embeddings)"""


def _vecs(s, d):
    """Vectors as token vectors: sequences of 97 places by vec_id, of which 20 to 97 count."""
    k = F.col("vec_id")
    return A.read(s, d, "embeddings").select(F.floor(k / 97).cast("string").alias("cell_id"), (k % 97).cast("int").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), (20 + F.floor(k / 97) * 37 % 78).cast("int").alias("length"))


@query("t9_mean_pool", f"WITH {_VECS}, x AS (SELECT cell_id, pos, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM vecs WHERE pos < length), m AS (SELECT cell_id, dim, round(avg(v), 6) + 0.0 AS v FROM x GROUP BY ALL) SELECT cell_id, list(v ORDER BY dim) AS embedding FROM m GROUP BY 1")
def t9(s, d):
    return T.mean_pool_tokens(_vecs(s, d))


@query("t10_pool_tokens", f"""WITH {_VECS}, x AS (SELECT cell_id, pos, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM vecs), m AS (SELECT cell_id, dim, arg_max(v, pos) AS a, list(v ORDER BY pos DESC)[2] AS b, max(v) AS c, round(avg(v), 6) + 0.0 AS e FROM x GROUP BY ALL)
  SELECT cell_id, list_concat(list_concat(list(a ORDER BY dim), list(b ORDER BY dim)), list_concat(list(c ORDER BY dim), list(e ORDER BY dim))) AS embedding FROM m GROUP BY 1""")
def t10(s, d):
    return T.pool_tokens(_vecs(s, d), "all")


# --- samples and splits ---

_MD = lambda c, seed: f"md5({c} || ':{seed}')"
_QUOTA = """q0 AS (SELECT *, round(least(CAST({n} AS BIGINT), sum(size) OVER (PARTITION BY {run})) * size / sum(size) OVER (PARTITION BY {run}), 9) AS share, least(CAST({n} AS BIGINT), sum(size) OVER (PARTITION BY {run})) AS goal FROM sizes),
  q1 AS (SELECT *, row_number() OVER (PARTITION BY {run} ORDER BY round(share - floor(share), 9) DESC, {by}) AS nth, goal - sum(floor(share)) OVER (PARTITION BY {run}) AS rest FROM q0),
  quota AS (SELECT {run}, {by}, floor(share) + CAST(nth <= rest AS INTEGER) AS quota FROM q1)"""


@query("p1_sample_n", f"WITH {CELLS} SELECT cell_id FROM cells ORDER BY {_MD('cell_id', 7)}, cell_id LIMIT 300")
def p1(s, d):
    return P.sample_n(A.cells(s, d), 300, 7).select("cell_id")


@query("p2_sample_stratified", f"""WITH {CELLS}, k AS (SELECT floor(score / 500) AS g, count(*) AS k FROM cells GROUP BY 1), nm AS (SELECT g, CASE WHEN k = 1 THEN '__single' ELSE CAST(CAST(g AS BIGINT) AS VARCHAR) END AS stratum, k FROM k),
  sizes AS (SELECT 0 AS one, stratum, sum(k) AS size FROM nm GROUP BY ALL), {_QUOTA.format(n=400, run='one', by='stratum')},
  x AS (SELECT cell_id, batch, stratum, quota, row_number() OVER (PARTITION BY stratum ORDER BY {_MD('cell_id', 3)}, cell_id) AS nth FROM cells JOIN nm ON nm.g = floor(score / 500) JOIN quota USING (stratum)) SELECT cell_id, batch FROM x WHERE nth <= quota""")
def p2(s, d):
    return P.sample_stratified(A.cells(s, d).withColumn("g", F.floor(F.col("score") / 500).cast("long")), 400, "g", 3).select("cell_id", "batch")


@query("p3_bootstrap_samples", f"""WITH {CELLS}, r AS (SELECT *, CAST(unnest(range(4)) AS INTEGER) AS run FROM cells), sizes AS (SELECT run, batch, count(*) AS size FROM r GROUP BY ALL), {_QUOTA.format(n=200, run='run', by='batch')},
  x AS (SELECT run, cell_id, quota, row_number() OVER (PARTITION BY run, batch ORDER BY md5(cell_id || ':' || (run + 42)), cell_id) AS nth FROM r JOIN quota USING (run, batch)) SELECT run, cell_id FROM x WHERE nth <= quota""")
def p3(s, d):
    return P.bootstrap_samples(A.cells(s, d), 4, 200, "batch", 42).select("run", "cell_id")


_PAT = f"{CELLS}, pat AS (SELECT sample_id, min(label) AS label, count(*) AS n_cells FROM cells GROUP BY 1)"


def _split(src, size, seed, one="test", other="train"):
    return f"""SELECT sample_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':{seed}'), sample_id) <= least(greatest(round(count(*) OVER (PARTITION BY label) * CAST({size} AS DOUBLE)), 1), count(*) OVER (PARTITION BY label) - 1) THEN '{one}' ELSE '{other}' END AS role FROM {src}"""


def _patients(s, d):
    from ..operators.cells import patient_info

    return patient_info(A.cells(s, d))


@query("p4_train_test_split", f"WITH {_PAT} {_split('pat', 0.3, 5)}")
def p4(s, d):
    return P.train_test_split(_patients(s, d), 0.3, 5).select("sample_id", "label", "role")


_FOLD = "folds AS (SELECT sample_id, label, CAST((row_number() OVER (ORDER BY label, md5(sample_id || ':11'), sample_id) - 1) % 5 AS INTEGER) AS fold FROM pat)"


@query("p5_stratified_kfold", f"WITH {_PAT}, {_FOLD} SELECT * FROM folds")
def p5(s, d):
    return P.stratified_kfold(_patients(s, d), 5, 11).select("sample_id", "label", "fold")


@query("p6_group_kfold", f"WITH {CELLS}, g AS (SELECT sample_id, CAST((row_number() OVER (ORDER BY md5(sample_id || ':2'), sample_id) - 1) % 4 AS INTEGER) AS fold FROM (SELECT DISTINCT sample_id FROM cells)) SELECT cell_id, sample_id, fold FROM cells JOIN g USING (sample_id)")
def p6(s, d):
    return P.group_kfold(A.cells(s, d), "sample_id", 4, 2).select("cell_id", "sample_id", "fold")


@query("p7_loocv", f"WITH {_PAT}, i AS (SELECT sample_id, label, CAST(row_number() OVER (ORDER BY sample_id) - 1 AS INTEGER) AS fold FROM pat) SELECT a.sample_id, a.label, b.fold, CASE WHEN a.sample_id = b.sample_id THEN 'test' ELSE 'train' END AS role FROM i a CROSS JOIN i b")
def p7(s, d):
    return P.loocv(P.kfold_roles(P.stratified_kfold(_patients(s, d), 5, 11)))


@query("p8_three_way_split", f"WITH {_PAT}, a AS ({_split('pat', 0.2, 9)}), t AS (SELECT * FROM a WHERE role = 'train') SELECT * FROM a WHERE role = 'test' UNION ALL {_split('t', 0.25, 10, 'validation')}")
def p8(s, d):
    return P.three_way_split(_patients(s, d), 9).select("sample_id", "label", "role")


@query("p9_oversample", f"""WITH {_PAT}, x AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY md5(sample_id || ':1'), sample_id) - 1 AS i FROM pat), m AS (SELECT max(n) AS m FROM x)
  SELECT sample_id, label, CAST(1 + (m - n) // n + CAST(i < (m - n) % n AS INTEGER) AS INTEGER) AS multiplicity FROM x, m""")
def p9(s, d):
    return P.oversample(_patients(s, d), 1).select("sample_id", "label", "multiplicity")


@query("p10_undersample", f"WITH {CELLS}, x AS (SELECT cell_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(cell_id || ':1'), cell_id) AS i FROM cells) SELECT cell_id, label FROM x WHERE i <= (SELECT min(n) FROM (SELECT count(*) AS n FROM cells GROUP BY label))")
def p10(s, d):
    return P.undersample(A.cells(s, d), 1, "cell_id").select("cell_id", "label")


@query("p11_is_imbalanced", f"WITH {CELLS}, n AS (SELECT count(*) AS n FROM cells GROUP BY label) SELECT min(n) / max(n) AS ratio, min(n) / max(n) < 0.8 AS imbalanced FROM n")
def p11(s, d):
    return P.is_imbalanced(A.cells(s, d))


@query("p12_apply_split", f"WITH {_PAT}, {_FOLD} SELECT cell_id, c.sample_id, k.fold, CASE WHEN k.fold = f.fold THEN 'test' ELSE 'train' END AS role FROM cells c JOIN folds f USING (sample_id) CROSS JOIN (SELECT DISTINCT fold FROM folds) k")
def p12(s, d):
    roles = P.kfold_roles(P.stratified_kfold(_patients(s, d), 5, 11)).drop("label")
    return P.apply_split(A.cells(s, d), roles).select("cell_id", "sample_id", "fold", "role")


@query("p13_pos_weight", f"WITH {_PAT} SELECT count(*) FILTER (label = 0) / count(*) FILTER (label = 1) AS pos_weight FROM pat")
def p13(s, d):
    return P.pos_weight(A.cells(s, d))


@query("p14_split_summary", f"WITH {_PAT}, {_FOLD} SELECT k.fold, CASE WHEN k.fold = f.fold THEN 'test' ELSE 'train' END AS role, label, count(*) AS n FROM folds f CROSS JOIN (SELECT DISTINCT fold FROM folds) k GROUP BY ALL")
def p14(s, d):
    return P.split_summary(P.kfold_roles(P.stratified_kfold(_patients(s, d), 5, 11)))
