"""R*: collecting, comparing and summarising runs."""

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import report as R
from ..plans import adapters as A
from ..plans.adapters import CATALOG, METRICS, MODELS, query

def _names(s, d):
    return sorted(r[0] for r in A.read(s, d, "events").select("event_type").distinct().collect())  # metric names: a handful


@query("r1_widen", f"WITH {METRICS}, m AS (SELECT run_id, fold, metric, min(value) AS v FROM metrics GROUP BY ALL) SELECT run_id, fold, list(metric ORDER BY metric) AS names, list(v ORDER BY metric) AS values FROM m GROUP BY ALL")
def r1(s, d):
    names = _names(s, d)
    w = R.widen(A.metrics(s, d), ["run_id", "fold"], names)
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names]), lambda x: x["value"].isNotNull())
    return w.select("run_id", "fold", pairs.alias("wide")).select("run_id", "fold", F.col("wide.metric").alias("names"), F.col("wide.value").alias("values"))


@query("r2_combine_strategies", f"WITH {METRICS} SELECT run_id, exp, model, metric, value, CASE WHEN strategy = 'avg' THEN fold END AS fold, strategy FROM metrics WHERE exp <> 'exp3'")
def r2(s, d):
    m = A.metrics(s, d)
    parts = {"avg": m.where("strategy = 'avg'").drop("strategy"), "vote": m.where("strategy = 'vote'").drop("strategy", "fold")}
    return R.combine_strategies(parts, "exp3")


@query("r3_fold_means", f"WITH {METRICS} SELECT run_id, metric, round(coalesce(avg(value) FILTER (strategy = 'vote'), avg(value) FILTER (strategy <> 'vote')), 6) AS mean FROM metrics GROUP BY ALL")
def r3(s, d):
    return R.fold_means(A.metrics(s, d), ["run_id"]).withColumn("mean", r6("mean"))


@query("r4_summarize", f"""WITH {METRICS} SELECT exp, model, run_id, round(avg(value) FILTER (lower(metric) = 'error'), 6) AS mean, CASE WHEN count(*) FILTER (lower(metric) = 'error') = 1 THEN 0 ELSE round(stddev_samp(value) FILTER (lower(metric) = 'error'), 6) END AS sd,
  count(*) FILTER (lower(metric) = 'error') AS n, CASE WHEN count(*) FILTER (lower(metric) = 'error') = 0 THEN 'no ERROR' END AS note FROM metrics GROUP BY ALL""")
def r4(s, d):
    return R.summarize(A.metrics(s, d), "ERROR", ["exp", "model", "run_id"]).withColumns({"mean": r6("mean"), "sd": r6("sd")})


@query("r5_mean_std", f"WITH {METRICS} SELECT exp, metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM metrics GROUP BY ALL")
def r5(s, d):
    return R.mean_std(A.metrics(s, d), ["exp"]).withColumns({"mean": r6("mean"), "sd": r6("sd")})


_RANK = f"{METRICS}, mm AS (SELECT exp, model, round(avg(value), 6) AS mean FROM metrics GROUP BY ALL), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY exp ORDER BY mean, model) AS INTEGER) AS rank FROM mm)"


@query("r6_rank_in_group", f"WITH {_RANK} SELECT rk.*, n FROM rk JOIN (SELECT exp, model, count(*) AS n FROM metrics GROUP BY ALL) USING (exp, model)")
def r6_(s, d):
    m = A.metrics(s, d)
    ranked = R.rank_in_group(m, "exp", "model", "value")
    n = R.align_to(m.groupBy("exp", "model").agg(F.count("*").alias("n")), ranked, "exp", "model")
    return ranked.join(n.drop("rank"), ["exp", "model"])


@query("r7_task_model_matrix", f"""WITH {METRICS}, c AS (SELECT exp, model, round(avg(value), 6) AS v FROM metrics GROUP BY ALL) SELECT exp, {', '.join(f'''max(v) FILTER (model = '{m}') AS "{m}"''' for m in MODELS)}, round(avg(v), 6) AS row_mean FROM c GROUP BY 1""")
def r7(s, d):
    return R.task_model_matrix(A.metrics(s, d), list(MODELS))


@query("r8_cross_table", f"WITH {METRICS}, c AS (SELECT strategy, exp, metric, round(avg(value), 3) AS v FROM metrics GROUP BY ALL) SELECT strategy, exp, list(metric ORDER BY metric) AS names, list(v ORDER BY metric) AS values FROM c GROUP BY ALL")
def r8(s, d):
    names = _names(s, d)
    w = R.cross_table(A.metrics(s, d), names)
    return w.select("strategy", "exp", F.filter(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names]), lambda x: x["value"].isNotNull()).alias("row")).select("strategy", "exp", F.col("row.metric").alias("names"), F.col("row.value").alias("values"))


@query("r9_task_snr", f"WITH {METRICS}, m AS (SELECT exp, model, avg(value) / stddev_samp(value) AS r FROM metrics GROUP BY ALL) SELECT exp, round(avg(r), 6) AS snr FROM m GROUP BY 1")
def r9(s, d):
    return R.task_snr(A.metrics(s, d)).withColumn("snr", r6("snr"))


_SIZES = f"sz AS (SELECT unnest({list(MODELS)}) AS model, unnest([{', '.join(str(i * 1000000) if i > 2 else '0' for i in range(len(MODELS)))}]) AS n_params)"


@query("r10_with_model_size", f"WITH {METRICS}, {_SIZES} SELECT model, n_params, count(*) AS n, round(avg(value), 6) AS mean, n_params = 0 AS baseline FROM metrics JOIN sz USING (model) GROUP BY ALL")
def r10(s, d):
    sizes = s.createDataFrame([(m, i * 1000000 if i > 2 else 0) for i, m in enumerate(MODELS)], "model string, n_params int")
    m = A.metrics(s, d)
    both = R.with_model_size(m, sizes).withColumn("baseline", F.lit(False)).unionByName(R.with_model_size(m, sizes, True).withColumn("baseline", F.lit(True)))
    return both.groupBy("model", "n_params", "baseline").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


_TT = f"""{METRICS}, mo AS (SELECT model, count(value) AS n, avg(value) AS mean, var_samp(value) AS var FROM metrics GROUP BY 1),
  tt AS (SELECT a.model AS a, b.model AS b, a.mean - b.mean AS diff, (a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t, a.n + b.n - 2 AS df FROM mo a JOIN mo b ON a.model < b.model)"""


@query("r11_pairwise_ttest", f"WITH {_TT} SELECT a, b, round(diff, 6) AS diff, round(t, 6) AS t, df, CASE WHEN diff > 0 THEN a WHEN diff < 0 THEN b END AS direction FROM tt")
def r11(s, d):
    return R.pairwise_ttest(A.metrics(s, d), "model", "value").withColumns({"diff": r6("diff"), "t": r6("t")})


@query("r11_ttest_p")
def r11b(s, d):
    return R.with_p(R.pairwise_ttest(A.metrics(s, d), "model", "value")).withColumn("p", r6("p"))


_PSEUDO_P = "ps AS (SELECT a, b, CASE WHEN diff > 0 THEN a WHEN diff < 0 THEN b END AS direction, 1 / (1 + t * t) AS p FROM tt)"
_BH = f"""{_TT}, {_PSEUDO_P}, rr AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS r, count(*) OVER () AS m FROM ps), bh AS (SELECT *, least(1, min(p * m / r) OVER (ORDER BY r DESC)) AS p_adj FROM rr)"""


def _tests(s, d):
    return R.pairwise_ttest(A.metrics(s, d), "model", "value").withColumn("p", 1 / (1 + F.col("t") * F.col("t")))


@query("r12_bh_adjust", f"WITH {_BH} SELECT a, b, round(p, 6) AS p, round(p_adj, 6) AS p_adj, p_adj < 0.05 AS significant FROM bh")
def r12(s, d):
    return R.bh_adjust(_tests(s, d)).select("a", "b", r6("p").alias("p"), r6("p_adj").alias("p_adj"), "significant")


@query("r13_directional_matrix", f"""WITH {_BH}, dm AS (SELECT direction AS winner, CASE WHEN direction = a THEN b ELSE a END AS loser, round(least(10, -log10(greatest(p_adj, 1e-300))), 6) AS v FROM bh WHERE direction IS NOT NULL)
  SELECT winner, {', '.join(f'''coalesce(max(v) FILTER (loser = '{m}'), 0) AS "{m}"''' for m in MODELS)} FROM dm GROUP BY 1""")
def r13(s, d):
    return R.directional_matrix(R.bh_adjust(_tests(s, d)), list(MODELS))


_PAIRS = f"""{METRICS}, pa AS (SELECT model, exp, metric, round(avg(value) FILTER (strategy = 'avg'), 4) AS x, round(avg(value) FILTER (strategy = 'vote'), 4) AS y FROM metrics GROUP BY ALL), df AS (SELECT model, round(x - y, 9) AS d FROM pa WHERE round(x - y, 9) <> 0),
  ra AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2 AS r FROM df)"""


def _pairs(s, d):
    m = A.metrics(s, d)
    one = lambda k: F.round(F.avg(F.when(F.col("strategy") == k, F.col("value"))), 4)
    return m.groupBy("model", "exp", "metric").agg(one("avg").alias("x"), one("vote").alias("y"))


@query("r14_signed_rank", f"WITH {_PAIRS} SELECT model, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, count(*) AS n FROM ra GROUP BY 1")
def r14(s, d):
    return R.signed_rank(_pairs(s, d), ["model"])


@query("r14_wilcoxon_p")
def r14b(s, d):
    return R.wilcoxon_pairs(_pairs(s, d), ["model"]).withColumn("p", r6("p"))


@query("r15_group_medians", f"WITH {METRICS} SELECT exp, model, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3, count(*) OVER (PARTITION BY exp) AS n_items FROM metrics GROUP BY exp, model")
def r15(s, d):
    return R.group_medians(A.metrics(s, d), "exp", "model", "value").withColumns({c: r6(c) for c in ("median", "q1", "q3")})


_FAILS = f"{METRICS}, fl AS (SELECT *, CASE WHEN fold = 4 AND metric = 'error' THEN NULL ELSE value END AS v FROM metrics)"


def _failing(s, d):
    return A.metrics(s, d).withColumn("value", F.when((F.col("fold") == 4) & (F.col("metric") == "error"), None).otherwise(F.col("value")))


@query("r16_aggregate_bootstrap", f"WITH {_FAILS} SELECT model, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(median(v), 6) AS median, count(*) AS n_runs FROM fl WHERE v IS NOT NULL GROUP BY ALL")
def r16(s, d):
    return R.aggregate_bootstrap(_failing(s, d), ["model", "metric"])[0].withColumns({c: r6(c) for c in ("mean", "sd", "median")})


@query("r16_failures", f"WITH {_FAILS} SELECT run_id, exp, model, strategy, fold, metric FROM fl WHERE v IS NULL")
def r16b(s, d):
    return R.aggregate_bootstrap(_failing(s, d), ["model", "metric"])[1].drop("value")


@query("r17_embedding_rows", f"WITH {METRICS}, c AS (SELECT run_id, strategy || '::' || metric AS k, round(avg(value), 6) AS v FROM metrics GROUP BY ALL) SELECT run_id, list(k ORDER BY k) AS names, list(v ORDER BY k) AS values FROM c GROUP BY 1")
def r17(s, d):
    names = sorted(f"{a}::{n}" for a in ("avg", "vote") for n in _names(s, d))
    w = R.embedding_rows(A.metrics(s, d), "strategy", names)
    return w.select("run_id", F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value")) for n in names]), lambda x: x["value"].isNotNull()).alias("row")).select("run_id", F.col("row.name").alias("names"), F.col("row.value").alias("values"))


@query("r18_combine_methods", f"WITH {METRICS} SELECT model AS method, exp AS task, value AS score FROM metrics WHERE strategy = 'avg' AND metric <> 'error' UNION ALL SELECT model, exp, value FROM metrics WHERE strategy = 'vote'")
def r18(s, d):
    m = A.metrics(s, d)
    return R.combine_methods([m.where("strategy = 'avg' and metric <> 'error'"), m.where("strategy = 'vote'")], {"model": "method", "exp": "task", "value": "score"})


@query("r19_compare_variants", f"WITH {METRICS} SELECT exp, metric, round(avg(value) FILTER (model IN ('gf_v2_ft', 'scGPT_cancer')), 6) AS finetuned, round(avg(value) FILTER (model IN ('GF-V1', 'scgpt_bc')), 6) AS frozen FROM metrics WHERE model IN ('gf_v2_ft', 'scGPT_cancer', 'GF-V1', 'scgpt_bc') GROUP BY ALL")
def r19(s, d):
    return R.compare_variants(A.metrics(s, d), {"gf_v2_ft": "finetuned", "scGPT_cancer": "finetuned", "GF-V1": "frozen", "scgpt_bc": "frozen"})


@query("r20_metric_profile", f"WITH {METRICS}, c AS (SELECT model, metric, coalesce(round(avg(value), 6), 0) AS mean, coalesce(round(stddev_samp(value), 6), 0) AS sd FROM metrics GROUP BY ALL), g AS (SELECT m.model, n.metric, coalesce(mean, 0) AS mean, coalesce(sd, 0) AS sd FROM (SELECT DISTINCT model FROM metrics) m CROSS JOIN (SELECT DISTINCT metric FROM metrics) n LEFT JOIN c USING (model, metric)) SELECT model, list(metric ORDER BY metric) AS names, list(mean ORDER BY metric) AS means, list(sd ORDER BY metric) AS sds FROM g GROUP BY 1")
def r20(s, d):
    names = _names(s, d)
    w = R.metric_profile(A.metrics(s, d), "model", names)
    return w.select("model", F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}_mean`").alias("mean"), F.col(f"`{n}_sd`").alias("sd")) for n in names]).alias("p")).select("model", F.col("p.metric").alias("names"), F.col("p.mean").alias("means"), F.col("p.sd").alias("sds"))


_RULES = [("hvg", "log_normalized", "error"), ("pca_n20", "log_normalized", "warning"), ("GF-V1", "raw_counts", "error"), ("scGPT_cancer", "raw_counts", "error"), ("scVI", "raw_counts", "warning")]
_RUNS = f"""{METRICS}, ru AS (SELECT DISTINCT run_id, model AS method, CASE WHEN CAST(substr(run_id, 2) AS BIGINT) % 3 = 0 THEN 'raw_counts' ELSE 'log_normalized' END AS kind, CAST(substr(run_id, 2) AS BIGINT) % 2 = 0 AS normalize FROM metrics),
  rl AS (SELECT * FROM (VALUES {', '.join(str(r) for r in _RULES)}) t(method, needs, level)), j AS (SELECT * FROM ru LEFT JOIN rl USING (method)),
  ck AS (SELECT run_id, 'warning' AS severity, 'no rule for the method' AS message FROM j WHERE needs IS NULL UNION ALL SELECT run_id, level, 'needs raw counts' FROM j WHERE needs = 'raw_counts' AND kind <> 'raw_counts'
    UNION ALL SELECT run_id, 'warning', 'normalises raw counts' FROM j WHERE needs = 'raw_counts' AND normalize UNION ALL SELECT run_id, level, 'needs normalised data' FROM j WHERE needs = 'log_normalized' AND kind = 'raw_counts' AND NOT normalize)"""


def _validated(s, d):
    k = F.substring("run_id", 2, 20).cast("long")
    runs = A.metrics(s, d).select("run_id", F.col("model").alias("method"), F.when(k % 3 == 0, "raw_counts").otherwise("log_normalized").alias("kind"), (k % 2 == 0).alias("normalize")).distinct()
    return R.validate_runs(runs, s.createDataFrame(_RULES, "method string, needs string, level string"))


@query("r21_validate_runs", f"WITH {_RUNS} SELECT * FROM ck")
def r21(s, d):
    return _validated(s, d)


@query("r22_validation_summary", f"WITH {_RUNS} SELECT severity, count(*) AS n, count(DISTINCT run_id) AS n_runs FROM ck GROUP BY 1")
def r22(s, d):
    return R.validation_summary(_validated(s, d))


@query("r23_merge_catalog", f"""WITH {CATALOG}, o AS (SELECT * FROM catalog WHERE year < 2020), nw AS (SELECT upper(model_name) AS model_name, year, CASE WHEN year % 2 = 0 THEN status END AS status, category, modalities, github_url, benchmarked, size FROM catalog WHERE year >= 2018)
  SELECT *, CAST(NULL AS VARCHAR) AS added_date FROM o UNION ALL SELECT model_name, year, coalesce(status, 'unknown'), category, modalities, github_url, false, size, '2026-01-01' FROM nw WHERE github_url IS NOT NULL AND lower(model_name) NOT IN (SELECT lower(model_name) FROM o)""")
def r23(s, d):
    c = A.catalog(s, d)
    new = c.where("year >= 2018").withColumn("model_name", F.upper("model_name")).withColumn("status", F.when(F.col("year") % 2 == 0, F.col("status")))
    return R.merge_catalog(c.where("year < 2020"), new, "2026-01-01")


@query("r24_search_catalog", f"WITH {CATALOG} SELECT * FROM catalog WHERE list_has_any(modalities, ['atac', 'protein']) AND category IN ('foundation', 'baseline') AND contains(lower(model_name || ' ' || status), 'pub') ORDER BY year DESC, model_name")
def r24(s, d):
    return R.search_catalog(A.catalog(s, d), {"modalities": ["atac", "protein"], "category": ["foundation", "baseline"]}, "PUB").orderBy(F.desc("year"), "model_name")


@query("r25_catalog_counts", f"WITH {CATALOG} SELECT count(*) AS n, count(*) FILTER (benchmarked) AS n_benchmarked, count(*) FILTER (status = 'published') AS n_published, count(DISTINCT category) AS n_categories FROM catalog")
def r25(s, d):
    return R.catalog_counts(A.catalog(s, d))
