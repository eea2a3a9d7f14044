"""S*: readers and writers, each read back from what was written to the shared folder; and the plug-in point for embedders."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import splits as P
from ..plans import adapters as A
from ..plans.adapters import CELLS, EMB, EXPR, METRICS, PREDS, query
from ..plans.storage import shared_dir
from ..sources import runs, tables
from ..sources.embed import embed
from ..streaming.ledger import stream_ledger
from .feature_queries import _FOLD, _PAT, _patients


@query("s1_load_expression", f"WITH {EXPR}, {CELLS} SELECT e.cell_id, gene_id, value, cell_type AS label, batch FROM expr e JOIN cells USING (cell_id)")
def s1(s, d):
    x = A.expr(s, d)
    layers = x.withColumn("layer", F.lit("X")).unionByName(x.withColumn("value", F.col("value") * 2).withColumn("layer", F.lit("raw")))
    cells, values = tables.load_expression(A.cells(s, d), layers, "cell_type", "batch")
    return values.join(cells.select("cell_id", "label", "batch"), "cell_id")


@query("s2_read_feature_csv", f"WITH {CELLS} SELECT label_raw AS label, [score, CAST(label AS DOUBLE)] AS features FROM cells")
def s2(s, d):
    path = shared_dir(s)
    A.cells(s, d).select(F.col("label_raw").alias("label"), F.col("score").alias("f0"), F.col("label").alias("f1")).write.option("header", True).csv(path)
    return tables.read_feature_csv(s, path, "label string, f0 double, f1 double")


_ROLE = f"{_PAT}, {_FOLD}, ro AS (SELECT k.fold, CASE WHEN k.fold = f.fold THEN 'test' ELSE 'train' END AS role, sample_id AS id, CAST(label AS VARCHAR) AS label FROM folds f CROSS JOIN (SELECT DISTINCT fold FROM folds) k)"


def _roles(s, d):
    return P.kfold_roles(P.stratified_kfold(_patients(s, d), 5, 11)).select("fold", "role", F.col("sample_id").alias("id"), F.col("label").cast("string").alias("label"))


@query("s3_read_splits", f"WITH {_ROLE} SELECT * FROM ro")
def s3(s, d):
    path = shared_dir(s)
    tables.write_splits(_roles(s, d), path, "sample_id", "label", 11)
    return tables.read_splits(s, f"{path}/json")


@query("s4_write_splits", f"WITH {_ROLE} SELECT * FROM ro")
def s4(s, d):
    path = shared_dir(s)
    tables.write_splits(_roles(s, d), path)
    return s.read.option("header", True).schema("fold int, id string, label string, role string").csv(f"{path}/csv").select("fold", "role", "id", "label")


@query("s5_embedding_cache", f"WITH {EMB} SELECT cell_id, embedding, label FROM emb")
def s5(s, d):
    path = shared_dir(s)
    make = lambda: A.embeddings(s, d).drop("batch")
    tables.load_embedding(s, path, "X_pca", make)
    return tables.load_embedding(s, path, "X_pca", make).select("cell_id", "embedding", "label")


@query("s6_run_ledger", f"WITH {METRICS} SELECT run_id, count(*) AS n, round(avg(value), 6) AS emb__mean, CAST(NULL AS DOUBLE) AS clf_cv__max FROM metrics WHERE strategy = 'avg' GROUP BY 1 UNION ALL SELECT run_id, count(*), NULL, max(value) FROM metrics WHERE strategy = 'vote' GROUP BY 1")
def s6(s, d):
    path, m = shared_dir(s), A.metrics(s, d)
    runs.append_run(m.where("strategy = 'avg'").groupBy("run_id").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("emb__mean")), path)
    runs.append_run(m.where("strategy = 'vote'").groupBy("run_id").agg(F.count("*").alias("n"), F.max("value").alias("clf_cv__max")), path)
    return runs.read_ledger(s, path).select("run_id", "n", "emb__mean", "clf_cv__max")


@query("s7_scan_runs", f"WITH {METRICS} SELECT exp AS run_id, metric, value, fold, 'meta ' || exp AS note FROM metrics WHERE strategy = 'avg'")
def s7(s, d):
    root, m = shared_dir(s), A.metrics(s, d)
    names = sorted(r[0] for r in m.select("exp").distinct().collect())  # a folder per experiment: seven
    for strategy in ("avg", "vote"):
        m.where(F.col("strategy") == strategy).select("metric", "value", "fold", F.lit(strategy).alias("kind"), F.col("exp").alias("run")).write.mode("append").partitionBy("kind", "run").option("header", True).csv(f"{root}/out")
    found = runs.scan_runs(s, f"{root}/out", "*.csv", "kind=avg").withColumn("run_id", F.regexp_replace("run_id", "run=", ""))
    return runs.attach_metadata(found, s.createDataFrame([(n, f"meta {n}") for n in names], "run_id string, note string")).select("run_id", "metric", "value", "fold", "note")


def _evals(s, d):
    return A.metrics(s, d).groupBy(F.col("exp").alias("run_id"), F.lit("classification").alias("kind"), F.col("strategy").alias("variant"), "fold", "metric").agg(r6(F.avg("value")).alias("value"))


_EV = f"{METRICS}, ev AS (SELECT exp AS run_id, 'classification' AS kind, strategy AS variant, fold, metric, round(avg(value), 6) AS value FROM metrics GROUP BY ALL)"


@query("s8_build_results", f"WITH {_EV}, ag AS (SELECT run_id, kind, variant, metric, avg(value) AS v FROM ev GROUP BY ALL), tl AS (SELECT run_id, kind, variant, round(sum(v), 6) AS total FROM ag GROUP BY ALL) SELECT run_id, kind, variant, CAST(bool_or(fold = 0) AS BIGINT) AS n_folds, any_value(total) AS total FROM ev JOIN tl USING (run_id, kind, variant) GROUP BY ALL")
def s8(s, d):
    e = runs.build_results(_evals(s, d)).select("run_id", F.explode("evaluations").alias("e"))
    return e.select("run_id", "e.kind", "e.variant", F.size(F.filter("e.folds", lambda f: f["fold"] == 0)).cast("long").alias("n_folds"), r6(F.aggregate(F.map_values("e.aggregate"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("s9_merge_evaluation", f"WITH {_EV} SELECT run_id, CAST(CASE WHEN run_id = 'exp0' THEN 2 ELSE 3 END AS BIGINT) AS n_evaluations, run_id = 'exp0' AS replaced FROM ev GROUP BY 1")
def s9(s, d):
    docs = runs.build_results(_evals(s, d))
    first = docs.select("run_id", F.element_at("evaluations", 1).alias("evaluation"))
    new = first.withColumn("evaluation", F.when(F.col("run_id") == "exp0", F.col("evaluation")).otherwise(F.col("evaluation").withField("kind", F.lit("bootstrap"))))
    out = runs.merge_evaluation(docs, new)
    last = F.element_at("evaluations", -1)
    return out.select("run_id", F.size("evaluations").cast("long").alias("n_evaluations"), (last["kind"] == "classification").alias("replaced"))


@query("s10_parse_cv_metrics", f"WITH {METRICS}, p AS (SELECT run_id, metric, fold, avg(value) AS value FROM metrics GROUP BY ALL) SELECT run_id, metric, list(round(value, 9) ORDER BY fold) AS folds, round(avg(value), 9) AS mean FROM p GROUP BY ALL")
def s10(s, d):
    x = A.metrics(s, d).groupBy("run_id", "metric", F.concat(F.lit("fold_"), "fold").alias("name")).agg(F.avg("value").alias("value"))
    return runs.parse_cv_metrics(x).select("run_id", "metric", F.transform("folds", lambda f: F.round(f["value"], 9)).alias("folds"), F.round("mean", 9).alias("mean"))


@query("s11_read_gene_panel", "SELECT p_name || '-' || p_partkey AS gene_id, count(*) AS n FROM part WHERE p_partkey % 7 <> 0 GROUP BY 1")
def s11(s, d):
    path = shared_dir(s)
    k = F.col("p_partkey")
    line = F.when(k % 14 == 0, F.lit("# remark")).when(k % 7 == 0, F.lit("")).otherwise(F.concat("p_name", F.lit("-"), k, F.lit(",x,y")))
    A.read(s, d, "part").select(line.alias("value")).write.text(path)
    return tables.read_gene_panel(s, path).groupBy("gene_id").agg(F.count("*").alias("n"))


@query("s12_write_eval", f"WITH {PREDS} SELECT row_id, label, pred, pred_score, run_id AS strategy, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS role FROM preds")
def s12(s, d):
    path = shared_dir(s)
    p = A.predictions(s, d).select("row_id", "label", "pred", "pred_score", F.col("run_id").alias("strategy"), F.when(F.col("fold") == 0, "test").otherwise("train").alias("role"))
    tables.write_eval(p, path)
    return tables.read_eval(s, path, "row_id string, label int, pred int, pred_score double, strategy string, role string")


@query("s13_embed_plugin", f"WITH {EXPR} SELECT cell_id, [CAST(count(*) AS DOUBLE), sum(value), max(value)] AS embedding FROM expr GROUP BY 1")
def s13(s, d):
    return embed(A.expr(s, d), lambda genes, values: [float(len(values)), float(values.sum()), float(values.max())])


@query("s14_ledger_stream", f"WITH {METRICS} SELECT run_id, count(*) AS n FROM metrics GROUP BY 1")
def s14(s, d):
    root = shared_dir(s)
    rows = A.read(s, d, "events").groupBy(F.concat(F.lit("r"), "user_id").alias("run_id")).agg(F.count("*").alias("n"), F.min("ts").cast("timestamp").alias("started"))
    rows.write.parquet(f"{root}/in")
    again = s.read.parquet(f"{root}/in")
    again.write.mode("append").parquet(f"{root}/in")  # every run arrives twice
    stream_ledger(s, f"{root}/in", again.schema, f"{root}/out", f"{root}/state").awaitTermination()
    return s.read.schema(again.schema).parquet(f"{root}/out").select("run_id", "n")
