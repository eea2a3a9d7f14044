"""Collecting, comparing and summarising runs."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import t_two_sided, wilcoxon_p


def widen(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per keys, one column per metric (the smallest value where one is repeated)."""
    return metrics.groupBy(*keys).pivot("metric", names).agg(F.min("value"))


def combine_strategies(parts: dict[str, DataFrame], drop: str | None = None) -> DataFrame:
    """Tables with their strategy as a column, missing columns null; rows of the task `drop` go."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("strategy", F.lit(k)) for k, df in parts.items()))
    return out.where(F.col("exp") != drop) if drop else out


def fold_means(metrics: DataFrame, keys: list[str], prefer: str = "vote") -> DataFrame:
    """Mean by metric of the preferred strategy, of the other where that is missing."""
    m = metrics.groupBy(*keys, "metric").agg(F.avg(F.when(F.col("strategy") == prefer, F.col("value"))).alias("a"), F.avg(F.when(F.col("strategy") != prefer, F.col("value"))).alias("b"))
    return m.select(*keys, "metric", F.coalesce("a", "b").alias("mean"))


def summarize(metrics: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """mean, sd (0 for one value), n of one metric whatever its case; a note where a group lacks it."""
    hit = F.lower("metric") == name.lower()
    s = metrics.groupBy(*keys).agg(F.avg(F.when(hit, F.col("value"))).alias("mean"), F.stddev_samp(F.when(hit, F.col("value"))).alias("sd"), F.count_if(hit).alias("n"))
    return s.withColumn("sd", F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd"))).withColumn("note", F.when(F.col("n") == 0, f"no {name}"))


def mean_std(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def rank_in_group(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Items by mean inside each group, ties by item."""
    m = df.groupBy(group, item).agg(F.round(F.avg(value), 6).alias("mean"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("mean", item)))


def align_to(df: DataFrame, ranked: DataFrame, group: str, item: str) -> DataFrame:
    return df.join(ranked.select(group, item, "rank"), [group, item])


def task_model_matrix(df: DataFrame, models: list[str]) -> DataFrame:
    """Means by task and model, wide, with the row average to order by."""
    w = df.groupBy("exp").pivot("model", models).agg(F.round(F.avg("value"), 6))
    vals = F.filter(F.array(*[F.col(f"`{m}`") for m in models]), lambda x: x.isNotNull())
    return w.withColumn("row_mean", F.round(F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals), 6))


def cross_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.groupBy("strategy", "exp").pivot("metric", names).agg(F.round(F.avg("value"), 3))


def task_snr(metrics: DataFrame) -> DataFrame:
    """Mean over models of mean / sd, by task."""
    m = metrics.groupBy("exp", "model").agg((F.avg("value") / F.stddev_samp("value")).alias("r"))
    return m.groupBy("exp").agg(F.avg("r").alias("snr"))


def with_model_size(df: DataFrame, sizes: DataFrame, baseline: bool = False) -> DataFrame:
    """sizes(model, n_params) joined; models without parameters apart."""
    x = df.join(sizes, "model")
    return x.where("n_params = 0" if baseline else "n_params > 0")


def pairwise_ttest(df: DataFrame, by: str, value: str) -> DataFrame:
    """All pairs of groups: pooled-variance t from counts, means and variances."""
    m = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    a, b = m.select(*[F.col(c).alias(f"{c}_a") for c in m.columns]), m.select(*[F.col(c).alias(f"{c}_b") for c in m.columns])
    x = a.join(b, F.col(f"{by}_a") < F.col(f"{by}_b"))
    df_ = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / df_
    diff = F.col("mean_a") - F.col("mean_b")
    x = x.select(F.col(f"{by}_a").alias("a"), F.col(f"{by}_b").alias("b"), diff.alias("diff"), (diff / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))).alias("t"), df_.alias("df"))
    return x.withColumn("direction", F.when(F.col("diff") > 0, F.col("a")).when(F.col("diff") < 0, F.col("b")))


def with_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", t_two_sided("t", F.col("df").cast("double")))


def bh_adjust(df: DataFrame, p: str = "p", alpha: float = 0.05, keys: tuple = ("a", "b")) -> DataFrame:
    """Benjamini-Hochberg over a small table of tests."""
    rank = F.row_number().over(Window.orderBy(p, *keys))
    x = df.withColumn("__r", rank).withColumn("__m", F.count(p).over(Window.partitionBy()))
    adj = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, 0)))
    return x.withColumn("p_adj", adj).withColumn("significant", F.col("p_adj") < alpha).drop("__r", "__m")


def directional_matrix(tests: DataFrame, names: list[str], cap: float = 10.0) -> DataFrame:
    """Row beats column: -log10 of the adjusted p, capped; 0 elsewhere."""
    v = F.least(F.lit(cap), -F.log10(F.greatest("p_adj", F.lit(1e-300))))
    x = tests.where("direction is not null").select(F.col("direction").alias("winner"), F.when(F.col("direction") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"), F.round(v, 6).alias("v"))
    return x.groupBy("winner").pivot("loser", names).agg(F.max("v")).fillna(0.0, names)


def signed_rank(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs(by, x, y) -> w, the smaller sum of ranks of |x - y|, ties averaged, zeros dropped; n pairs."""
    d = pairs.withColumn("d", F.round(F.col("x") - F.col("y"), 9)).where("d <> 0").withColumn("k", F.abs("d"))
    w = Window.partitionBy(*by)
    r = F.rank().over(w.orderBy("k")) + (F.count("*").over(Window.partitionBy(*by, "k")) - 1) / 2
    s = d.withColumn("r", r).groupBy(*by).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("minus"), F.count("*").alias("n"))
    return s.select(*by, F.least("plus", "minus").alias("w"), "n")


def wilcoxon_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    return signed_rank(pairs, by).withColumn("p", wilcoxon_p("w", F.col("n").cast("double")))


def group_medians(df: DataFrame, group: str, item: str, value: str) -> DataFrame:
    """Quartiles of each item, and how many items its group has."""
    m = df.groupBy(group, item).agg(F.median(value).alias("median"), F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    return m.withColumn("n_items", F.count("*").over(Window.partitionBy(group)))


def aggregate_bootstrap(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Means, deviations and medians over runs, and the rows whose value failed."""
    ok = df.where("value is not null and not isnan(value)")
    return ok.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.median("value").alias("median"), F.count("*").alias("n_runs")), df.where("value is null or isnan(value)")


def embedding_rows(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row per run, columns 'key::metric' in order."""
    return df.withColumn("__c", F.concat_ws("::", key, "metric")).groupBy("run_id").pivot("__c", sorted(names)).agg(F.round(F.avg("value"), 6))


def combine_methods(parts: list[DataFrame], columns: dict[str, str]) -> DataFrame:
    """Chosen columns of all tables under common names."""
    return reduce(lambda a, b: a.unionByName(b), (p.select(*[F.col(c).alias(n) for c, n in columns.items()]) for p in parts))


def compare_variants(df: DataFrame, variants: dict[str, str]) -> DataFrame:
    """variants: model -> 'finetuned' or 'frozen'; means by task and variant side by side."""
    from .cells import lookup

    x = lookup(df, "model", variants, "variant").where("variant is not null")
    return x.groupBy("exp", "metric").pivot("variant", sorted(set(variants.values()))).agg(F.round(F.avg("value"), 6))


def metric_profile(df: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Mean and deviation of each metric, wide, nulls as 0."""
    w = df.groupBy(by).pivot("metric", names).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))
    return w.fillna(0.0)


def validate_runs(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """runs(run_id, method, kind, normalize), rules(method, needs, level): one row per breach."""
    x = runs.join(rules, "method", "left")
    checks = F.array(
        F.when(F.col("needs").isNull(), F.struct(F.lit("warning").alias("severity"), F.lit("no rule for the method").alias("message"))),
        F.when((F.col("needs") == "raw_counts") & (F.col("kind") != "raw_counts"), F.struct(F.col("level").alias("severity"), F.lit("needs raw counts").alias("message"))),
        F.when((F.col("needs") == "raw_counts") & F.col("normalize"), F.struct(F.lit("warning").alias("severity"), F.lit("normalises raw counts").alias("message"))),
        F.when((F.col("needs") == "log_normalized") & (F.col("kind") == "raw_counts") & ~F.col("normalize"), F.struct(F.col("level").alias("severity"), F.lit("needs normalised data").alias("message"))))
    return x.select("run_id", F.explode(F.array_compact(checks)).alias("c")).select("run_id", "c.severity", "c.message")


def validation_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("n_runs"))


def merge_catalog(old: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """Old rows, then new ones with a URL whose name (whatever its case) is unknown, one per name; flags false, dated."""
    fresh = new.where("github_url is not null and trim(github_url) <> ''").join(old.select(F.lower("model_name").alias("__k")).distinct(), F.lower("model_name") == F.col("__k"), "left_anti")
    first = fresh.groupBy(F.lower("model_name").alias("__k")).agg(F.min_by(F.struct(*fresh.columns), F.struct("model_name", "github_url")).alias("r")).select("r.*")
    first = first.withColumn("status", F.coalesce("status", F.lit("unknown"))).withColumn("benchmarked", F.lit(False)).withColumn("added_date", F.lit(today))
    return old.withColumn("added_date", F.lit(None).cast("string")).unionByName(first)


def search_catalog(df: DataFrame, facets: dict[str, list[str]], text: str = "") -> DataFrame:
    """Array facets hold any of the wanted values, plain ones are among them; text occurs in the name, status or an array."""
    for c, wanted in facets.items():
        kind = dict(df.dtypes)[c]
        df = df.where(F.arrays_overlap(c, F.array(*map(F.lit, wanted))) if kind.startswith("array") else F.col(c).isin(wanted))
    if text:
        df = df.where(F.lower(F.concat_ws(" ", "model_name", "status", "modalities")).contains(text.lower()))
    return df


def catalog_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if("benchmarked").alias("n_benchmarked"), F.count_if(F.col("status") == "published").alias("n_published"), F.countDistinct("category").alias("n_categories"))
