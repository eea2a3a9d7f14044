"""F*, Q* and G*: filters, quality control, gene identifiers."""

from pyspark.sql import functions as F

from ..functions.columns import ensembl_stable, r6
from ..operators import cells as C
from ..operators import genes as G
from ..operators import qc as Q
from ..plans import adapters as A
from ..plans.adapters import CELLS, EMB, EXPR, GENES, METRICS, PARTEXPR, query


@query("f1_filter_cells", f"WITH {CELLS} SELECT * FROM cells WHERE batch IN ('BUILDING', 'FURNITURE', 'MACHINERY') AND label_raw IN ('pos')")
def f1(s, d):
    return C.filter_cells_in(A.cells(s, d), [{"column": "batch", "values": ["BUILDING", "FURNITURE", "MACHINERY"]}, {"column": "label_raw", "values": ["pos"]}])


@query("f2_encode_labels", f"WITH {CELLS} SELECT cell_id, batch, CASE batch WHEN 'BUILDING' THEN 0 WHEN 'FURNITURE' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code FROM cells")
def f2(s, d):
    return C.encode_labels(A.cells(s, d), {"BUILDING": 0, "FURNITURE": 1, "MACHINERY": 2}, "batch").select("cell_id", "batch", "code")


@query("f3_encode_sorted", f"WITH {CELLS} SELECT cell_id, CAST(dense_rank() OVER (ORDER BY batch) - 1 AS INTEGER) AS code FROM cells")
def f3(s, d):
    return C.encode_sorted(A.cells(s, d), "batch").select("cell_id", "code")


@query("f4_stratum_key", f"WITH {CELLS} SELECT cell_id, batch || '|' || label_raw AS stratum FROM cells")
def f4(s, d):
    return C.stratum_key(A.cells(s, d), "batch", "label_raw").select("cell_id", "stratum")


@query("f5_patient_info", f"WITH {CELLS} SELECT sample_id, min(label) AS label, count(*) AS n_cells FROM cells GROUP BY 1")
def f5(s, d):
    return C.patient_info(A.cells(s, d))


@query("f6_filter_patients", f"""WITH {CELLS}, p AS (SELECT sample_id, min(label) AS label, count(*) AS n_cells FROM cells GROUP BY 1 HAVING count(*) >= 50)
  SELECT p.*, CAST((SELECT least(12, min(n)) FROM (SELECT count(*) AS n FROM p GROUP BY label)) AS INTEGER) AS n_splits FROM p""")
def f6(s, d):
    return C.filter_patients(A.cells(s, d), 50, 12)


@query("f7_label_conflicts", f"WITH {CELLS} SELECT batch, count(DISTINCT label) AS n_labels FROM cells GROUP BY 1 HAVING count(DISTINCT label) > 1")
def f7(s, d):
    return C.label_conflicts(C.assert_single_label(A.cells(s, d)), "batch")


@query("f8_coerce_response", "SELECT user_id, min(try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS response FROM events WHERE try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL GROUP BY 1")
def f8(s, d):
    return C.coerce_response(A.read(s, d, "events").select("user_id", F.get_json_object("props", "$.k").alias("response")), "user_id", "response")


@query("f9_value_counts", f"WITH {CELLS} SELECT batch, cell_type, count(*) AS n FROM cells GROUP BY ALL")
def f9(s, d):
    return C.value_counts(A.cells(s, d), "batch", "cell_type")


_FAMILY = "CASE " + " ".join(f"WHEN contains(lower(model), '{a}') THEN '{b}'" for a, b in C.FAMILIES) + " ELSE 'other' END"


@query("f10_model_group", f'WITH {METRICS} SELECT model, {_FAMILY} AS "group", count(*) AS n FROM metrics GROUP BY ALL')
def f10(s, d):
    return C.model_group(A.metrics(s, d)).groupBy("model", "group").agg(F.count("*").alias("n"))


@query("f11_lookup", f"WITH {METRICS} SELECT DISTINCT model, CASE model WHEN 'hvg' THEN 'HVG' WHEN 'scVI' THEN 'scVI (VAE)' END AS display, CASE model WHEN 'hvg' THEN 'HVG' WHEN 'scVI' THEN 'scVI (VAE)' ELSE model END AS kept FROM metrics")
def f11(s, d):
    m = {"hvg": "HVG", "scVI": "scVI (VAE)"}
    return C.lookup(C.lookup(A.metrics(s, d), "model", m, "display"), "model", m, "kept", keep=True).select("model", "display", "kept").distinct()


@query("f12_parse_run_name", f"""WITH {METRICS}, n AS (SELECT DISTINCT run_id || '_exp' || '/emb_' || model || '_metrics.csv' AS name FROM metrics)
  SELECT replace(name, '_exp', '') AS run, split_part(split_part(name, 'emb_', 2), '_metrics', 1) AS part FROM n""")
def f12(s, d):
    n = A.metrics(s, d).select(F.concat("run_id", F.lit("_exp/emb_"), "model", F.lit("_metrics.csv")).alias("name")).distinct()
    return C.parse_run_name(n, "name", "emb_", "_metrics").select("run", "part")


@query("f13_embedding_key", f"""WITH {METRICS} SELECT DISTINCT model, CASE WHEN contains(lower(model), 'scgpt') THEN 'X_scGPT' WHEN contains(lower(model), 'gf') THEN 'X_geneformer' WHEN contains(lower(model), 'pca') THEN 'X_pca'
  WHEN contains(lower(model), 'n100') THEN 'X_pca100' END AS key FROM metrics""")
def f13(s, d):
    return C.embedding_key(A.metrics(s, d), [("n100", "X_pca100"), ("pca", "X_pca"), ("gf", "X_geneformer"), ("scgpt", "X_scGPT")]).select("model", "key").distinct()


@query("f14_with_order", f"WITH {CELLS}, {EXPR} SELECT c.*, coalesce(n, 0) AS n_counts FROM cells c LEFT JOIN (SELECT cell_id, sum(value) AS n FROM expr GROUP BY 1) USING (cell_id)")
def f14(s, d):
    return C.with_order(A.cells(s, d), A.expr(s, d))


@query("q1_cell_qc", f"""WITH {CELLS}, {EXPR} SELECT cell_id, count(*) FILTER (value > 0) AS n_genes_by_counts, coalesce(sum(value), 0) AS total_counts FROM cells LEFT JOIN expr USING (cell_id) GROUP BY 1""")
def q1(s, d):
    return Q.cell_qc(A.cells(s, d), A.expr(s, d))


@query("q2_gene_qc", f"""WITH {EXPR}, n AS (SELECT count(*) AS n FROM customer) SELECT gene_id, count(*) FILTER (value > 0) AS n_cells_by_counts, sum(value) AS total_counts, round(sum(value) / any_value(n), 6) AS mean_counts,
  round(100 - 100 * count(*) FILTER (value > 0) / any_value(n), 6) AS pct_dropout_by_counts FROM expr, n GROUP BY 1""")
def q2(s, d):
    return Q.gene_qc(A.expr(s, d), A.cells(s, d).count()).withColumns({c: r6(c) for c in ("mean_counts", "pct_dropout_by_counts")})


_QC = f"""{EXPR}, c1 AS (SELECT cell_id FROM expr WHERE value > 0 GROUP BY 1 HAVING count(*) >= 20), e1 AS (SELECT * FROM expr SEMI JOIN c1 USING (cell_id)),
  g1 AS (SELECT gene_id FROM e1 WHERE value > 0 GROUP BY 1 HAVING count(*) >= 250), qc AS (SELECT * FROM e1 SEMI JOIN g1 USING (gene_id))"""


@query("q3_qc", f"WITH {_QC} SELECT cell_id, gene_id, value FROM qc")
def q3(s, d):
    return Q.qc(A.expr(s, d), 20, 250).select("cell_id", "gene_id", "value")


@query("q4_filter_genes_frac", f"""WITH {PARTEXPR}, g AS (SELECT gene_id FROM pexpr WHERE value > 0 GROUP BY 1 HAVING count(*) / (SELECT count(*) FROM customer) >= 0.02) SELECT cell_id, gene_id, value FROM pexpr SEMI JOIN g USING (gene_id)""")
def q4(s, d):
    return Q.filter_genes_frac(A.expr(s, d, "part"), A.cells(s, d).count(), 0.02).select("cell_id", "gene_id", "value")


NORM = f"""{EXPR}, tot AS (SELECT cell_id, sum(value) AS total FROM expr GROUP BY 1), norm AS (SELECT cell_id, gene_id, CASE WHEN total > 0 THEN value * 10000 / total ELSE value END AS value FROM expr JOIN tot USING (cell_id)),
  logn AS (SELECT cell_id, gene_id, ln(1 + value) AS value FROM norm)"""


@query("q5_normalize_total", f"WITH {NORM} SELECT cell_id, gene_id, round(value, 6) AS value FROM norm")
def q5(s, d):
    return Q.normalize_total(A.expr(s, d), 1e4).withColumn("value", r6("value"))


@query("q5_normalize_median", f"WITH {NORM} SELECT cell_id, gene_id, round(value * (SELECT median(total) FROM tot WHERE total > 0) / total, 6) AS value FROM expr JOIN tot USING (cell_id)")
def q5b(s, d):
    return Q.normalize_total(A.expr(s, d), None).withColumn("value", r6("value"))


@query("q6_log1p", f"WITH {EXPR} SELECT cell_id, gene_id, round(ln(1 + value), 6) AS value, round(ln(1 + value) / ln(2.0), 6) AS value2 FROM expr")
def q6(s, d):
    x = A.expr(s, d)
    return Q.log1p(x).join(Q.log1p(x, 2).withColumnRenamed("value", "value2"), ["cell_id", "gene_id"]).withColumns({"value": r6("value"), "value2": r6("value2")})


@query("q7_snapshot_layer", f"WITH {EXPR}, l AS (SELECT 'X' AS layer UNION ALL SELECT 'counts') SELECT cell_id, gene_id, value, layer FROM expr, l")
def q7(s, d):
    x = A.expr(s, d).withColumn("layer", F.lit("X"))
    return Q.snapshot_layer(Q.snapshot_layer(x, "X", "counts"), "X", "counts").select("cell_id", "gene_id", "value", "layer")


@query("q8_scale", f"""WITH {NORM}, n AS (SELECT count(*) AS n FROM customer), m AS (SELECT gene_id, sum(value) / any_value(n) AS mean, sqrt(greatest(0, (sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1))) AS sd FROM logn, n GROUP BY 1)
  SELECT CAST(c_custkey AS VARCHAR) AS cell_id, m.gene_id, round(least(10, greatest(-10, (coalesce(value, 0) - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END)), 5) AS value FROM m CROSS JOIN customer LEFT JOIN logn e ON e.gene_id = m.gene_id AND e.cell_id = CAST(c_custkey AS VARCHAR)""")
def q8(s, d):
    return Q.scale(Q.log1p(Q.normalize_total(A.expr(s, d))), A.cells(s, d)).withColumn("value", F.round("value", 5))


@query("q8_scale_stored", f"""WITH {NORM}, n AS (SELECT count(*) AS n FROM customer), m AS (SELECT gene_id, sum(value) / any_value(n) AS mean, sqrt(greatest(0, (sum(value * value) - sum(value) * sum(value) / any_value(n)) / (any_value(n) - 1))) AS sd FROM logn, n GROUP BY 1),
  x AS (SELECT cell_id, gene_id, value FROM logn UNION ALL SELECT NULL, gene_id, 0 FROM m) SELECT cell_id, gene_id, round(least(10, greatest(-10, (value - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END)), 5) AS value FROM x JOIN m USING (gene_id)""")
def q8b(s, d):
    return Q.scale_stored(Q.log1p(Q.normalize_total(A.expr(s, d))), A.cells(s, d)).withColumn("value", F.round("value", 5))


@query("q9_matrix_range", f"""WITH {EXPR} SELECT CASE WHEN count(*) < any_value(c) * any_value(g) THEN least(min(value), 0) ELSE min(value) END AS min_value, max(value) AS max_value, count(*) AS stored
  FROM expr, (SELECT count(*) AS c FROM customer), (SELECT count(DISTINCT gene_id) AS g FROM expr)""")
def q9(s, d):
    x = A.expr(s, d)
    return Q.matrix_range(x, A.cells(s, d).count(), x.select("gene_id").distinct().count())


@query("q10_infer_matrix_kind", f"WITH {EXPR} SELECT max(value) AS hi, median(value) AS mid, round(quantile_cont(value, 0.99), 6) AS p99, avg(CAST(abs(value - round(value)) < 1e-6 AS INTEGER)) AS whole, 'raw_counts' AS kind FROM expr")
def q10(s, d):
    return Q.infer_matrix_kind(A.expr(s, d)).withColumn("p99", r6("p99"))


@query("q11_infer_gene_id_kind", f"""WITH {GENES}, x AS (SELECT avg(CAST(regexp_matches(gene_name, '(?i)^ENS[A-Z]{{0,10}}G\\d{{6,}}') AS INTEGER)) AS e, avg(CAST(regexp_matches(gene_name, '^[A-Za-z][A-Za-z0-9.-]{{0,14}}$') AS INTEGER)) AS y FROM genes)
  SELECT round(e, 6) AS ensembl_share, round(y, 6) AS symbol_share, CASE WHEN e > 0.5 THEN 'ensembl' WHEN y > 0.5 THEN 'symbol' ELSE 'unknown' END AS kind FROM x""")
def q11(s, d):
    return Q.infer_gene_id_kind(A.genes(s, d), "gene_name").withColumns({c: r6(c) for c in ("ensembl_share", "symbol_share")})


@query("q12_audit_embeddings", f"WITH {EMB} SELECT label, count(*) AS n_rows, CAST(max(len(embedding)) AS INTEGER) AS dims, count(*) <> 50 AS unexpected FROM emb GROUP BY 1")
def q12(s, d):
    return Q.audit_embeddings(A.embeddings(s, d), 50, "label")


def _describe(c, t):
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, min({c})::DOUBLE AS lo, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q2, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3, max({c})::DOUBLE AS hi, count(DISTINCT {c}) AS n_distinct FROM {t}"


@query("q13_describe", f"WITH {CELLS} {_describe('score', 'cells')} UNION ALL {_describe('label', 'cells')}")
def q13(s, d):
    return Q.describe(A.cells(s, d), "score", "label").withColumns({c: r6(c) for c in ("mean", "sd", "q1", "q2", "q3")})


_ENS = lambda c: f"nullif(upper(regexp_extract({c}, '(?i)(ENS[A-Z]{{0,10}}G\\d{{6,}})', 1)), '')"


@query("g1_ensembl_stable", f"WITH {GENES} SELECT gene_id, {_ENS('gene_name')} AS stable FROM genes")
def g1(s, d):
    return A.genes(s, d).select("gene_id", ensembl_stable("gene_name").alias("stable"))


def _names(s, d):
    """A dictionary: capital brand symbols and part names of even parts."""
    p = A.read(s, d, "part")
    k = F.col("p_partkey")
    ens = F.concat(F.lit("ENSG"), F.lpad(k.cast("string"), 11, "0"))
    return p.where(k % 2 == 0).select(F.when(k % 4 == 0, F.upper(F.regexp_replace("p_brand", "#", ""))).otherwise(F.col("p_name")).alias("symbol"), ens.alias("ensembl_id"))


_NAMES = """names AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN upper(replace(p_brand, '#', '')) ELSE p_name END AS symbol, 'ENSG' || lpad(CAST(p_partkey AS VARCHAR), 11, '0') AS ensembl_id FROM part WHERE p_partkey % 2 = 0)"""


@query("g2_map_symbols", f"""WITH {GENES}, {_NAMES}, ex AS (SELECT symbol, min(ensembl_id) AS e FROM names GROUP BY 1), up AS (SELECT upper(symbol) AS u, min(ensembl_id) AS e FROM names GROUP BY 1)
  SELECT g.gene_id, coalesce(ex.e, up.e, {_ENS('gene_name')}) AS mapped_id, CASE WHEN ex.e IS NOT NULL THEN 'exact' WHEN up.e IS NOT NULL THEN 'upper' ELSE 'parsed' END AS route
  FROM genes g LEFT JOIN ex ON ex.symbol = gene_name LEFT JOIN up ON up.u = upper(gene_name) WHERE coalesce(ex.e, up.e, {_ENS('gene_name')}) IS NOT NULL""")
def g2(s, d):
    return G.map_symbols(A.genes(s, d), _names(s, d)).select("gene_id", "mapped_id", "route")


@query("g3_map_ensembl", f"""WITH {GENES}, {_NAMES}, b AS (SELECT ensembl_id, min(symbol) AS name FROM names GROUP BY 1), x AS (SELECT gene_id, name, row_number() OVER (PARTITION BY name ORDER BY pos) - 1 AS k FROM genes JOIN b USING (ensembl_id))
  SELECT gene_id, CASE WHEN k = 0 THEN name ELSE name || '-' || k END AS unique_name FROM x""")
def g3(s, d):
    return G.map_ensembl(A.genes(s, d), _names(s, d))


@query("g4_coerce_map", f"WITH {GENES}, p AS (SELECT 'ENSG' || lpad(CAST(pos % 120 AS VARCHAR), 11, '0') AS e, symbol, pos FROM genes) SELECT e AS ensembl_id, arg_max(symbol, pos) AS symbol, count(DISTINCT symbol) > 1 AS collision FROM p GROUP BY 1")
def g4(s, d):
    g = A.genes(s, d)
    return G.coerce_map(g.select(F.col("symbol").alias("a"), F.concat(F.lit("ENSG"), F.lpad((F.col("pos") % 120).cast("string"), 11, "0")).alias("b"), "pos"))


@query("g5_choose_id_source", f"WITH {GENES}, x AS (SELECT avg(CAST({_ENS('gene_name')} IS NOT NULL AS INTEGER)) AS a, avg(CAST({_ENS('ensembl_id')} IS NOT NULL AS INTEGER)) AS b FROM genes) SELECT round(a, 6) AS in_column, round(b, 6) AS in_index, CASE WHEN a > 0.5 THEN 'column' WHEN b > 0.5 THEN 'index' ELSE 'dictionary' END AS source FROM x")
def g5(s, d):
    return G.choose_id_source(A.genes(s, d), "gene_name", "ensembl_id").withColumns({c: r6(c) for c in ("in_column", "in_index")})


@query("g6_resolve_key", f"""WITH {GENES}, {_NAMES}, v AS (SELECT DISTINCT symbol AS key FROM names), b AS (SELECT ensembl_id, min(symbol) AS symbol FROM names GROUP BY 1),
  t AS (SELECT gene_id, 0 AS priority, gene_name AS key FROM genes UNION ALL SELECT gene_id, 1, upper(gene_name) FROM genes UNION ALL SELECT gene_id, 2, b.symbol FROM genes JOIN b ON b.ensembl_id = {_ENS('gene_name')}
  UNION ALL SELECT gene_id, 3, genes.ensembl_id FROM genes UNION ALL SELECT gene_id, 4, upper(genes.ensembl_id) FROM genes UNION ALL SELECT gene_id, 5, b.symbol FROM genes JOIN b ON b.ensembl_id = {_ENS('genes.ensembl_id')})
  SELECT gene_id, arg_min(key, priority) AS key, min(priority) AS priority FROM t SEMI JOIN v USING (key) GROUP BY 1""")
def g6(s, d):
    n = _names(s, d)
    return G.resolve_key(A.genes(s, d), n.select(F.col("symbol").alias("key")), n, ["gene_name", "ensembl_id"])


def _panel(s, d):
    """Every other part as the panel, with parts that the data lack."""
    p = A.read(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("gene_id"), F.col("p_partkey").cast("int").alias("pos"))
    return p.unionByName(A.read(s, d, "supplier").select(F.concat(F.lit("x"), "s_suppkey").alias("gene_id"), (1000000 + F.col("s_suppkey")).cast("int").alias("pos")))


_PANEL = "panel AS (SELECT CAST(p_partkey AS VARCHAR) AS gene_id, CAST(p_partkey AS INTEGER) AS pos FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'x' || s_suppkey, CAST(1000000 + s_suppkey AS INTEGER) FROM supplier)"


@query("g7_panel_overlap", f"""WITH {GENES}, {_PANEL}, g AS (SELECT symbol, gene_id FROM genes), x AS (SELECT g.gene_id IS NOT NULL AS a, p.gene_id IS NOT NULL AS b FROM (SELECT DISTINCT gene_id FROM g) g FULL JOIN (SELECT DISTINCT gene_id FROM panel) p USING (gene_id)),
  c AS (SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_data, count(*) FILTER (b AND NOT a) AS only_panel FROM x)
  SELECT shared, only_data, only_panel, CAST(0 AS BIGINT) AS repeated, round(100 * shared / (shared + only_panel), 6) AS pct_of_panel, round(100 * shared / (shared + only_data), 6) AS pct_of_data FROM c""")
def g7(s, d):
    return G.panel_overlap(A.genes(s, d), _panel(s, d)).withColumns({c: r6(c) for c in ("pct_of_panel", "pct_of_data")})


@query("g8_align_panel", f"WITH {PARTEXPR}, {_PANEL} SELECT cell_id, gene_id, pos, value FROM pexpr JOIN panel USING (gene_id)")
def g8(s, d):
    return G.align_panel(A.expr(s, d, "part"), _panel(s, d))


@query("g8_panel_mask", f"WITH {PARTEXPR}, {_PANEL} SELECT gene_id, pos, CAST(gene_id NOT IN (SELECT gene_id FROM pexpr) AS INTEGER) AS mask FROM panel")
def g8b(s, d):
    return G.panel_mask(A.expr(s, d, "part"), _panel(s, d))


@query("g9_subset_reference", f"WITH {PARTEXPR}, {_PANEL} SELECT cell_id, gene_id, value FROM pexpr SEMI JOIN panel USING (gene_id)")
def g9(s, d):
    return G.subset_reference(A.expr(s, d, "part"), _panel(s, d)).select("cell_id", "gene_id", "value")


@query("g10_subset_means", f"WITH {GENES} SELECT gene_id, CASE WHEN pos % 2 = 0 THEN p_retailprice END AS mean FROM genes JOIN part ON CAST(p_partkey AS VARCHAR) = gene_id")
def g10(s, d):
    means = A.read(s, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("gene_id"), F.col("p_retailprice").alias("mean"))
    return G.subset_means(A.genes(s, d), means)
