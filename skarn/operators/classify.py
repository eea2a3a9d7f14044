"""Classifiers, cross-validation and scores. Score tables are first aggregated to distinct scores."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_order
from ..plans.storage import written
from . import logistic, patient, splits


def make_classifier(name: str, params: dict | None = None, seed: int = 42):
    """random_forest (also randomforest), logistic_regression or svc (a linear machine; fit_score maps its features first); an unknown name gives a random forest."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier

    p = dict(params or {})
    if name == "logistic_regression":
        return LogisticRegression(featuresCol="v", labelCol="label", maxIter=int(p.get("max_iter", 100)), **({"weightCol": "weight"} if p.get("balanced") else {}))
    if name == "svc":
        return LinearSVC(featuresCol="v", labelCol="label", maxIter=int(p.get("max_iter", 100)))
    return RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 5)), seed=seed)


def fourier_features(df: DataFrame, gamma: float, n: int = 512, seed: int = 42) -> DataFrame:
    """`embedding` replaced by n random Fourier features: their inner products estimate exp(-gamma |x - y|^2) to about 1 / sqrt(n), so a linear machine
    on them is a kernel machine whose fit stays distributed. Only d x n weights go to the tasks."""
    first = df.select(F.size("embedding")).first()
    if first is None:
        return df
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(first[0], n)), rng.uniform(0, 2 * np.pi, n)
    at = df.columns.index("embedding")

    def run(batches):
        for t in batches:
            if t.num_rows:
                z = np.sqrt(2 / n) * np.cos(t.column(at).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) @ w + b)
                z = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype="i4") * n), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([z if i == at else c for i, c in enumerate(t.columns)], names=t.schema.names)

    fields = ", ".join(f"`{f.name}` {'array<double>' if f.name == 'embedding' else f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, fields)


def scale_gamma(df: DataFrame) -> float:
    """1 / (d * variance of all values), the usual width of the kernel; 1 where nothing varies."""
    add = lambda f: F.sum(F.aggregate("embedding", F.lit(0.0), f))
    r = df.agg(F.sum(F.size("embedding")).alias("n"), add(lambda a, x: a + x).alias("s"), add(lambda a, x: a + x * x).alias("q"), F.max(F.size("embedding")).alias("d")).first()
    var = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 if r["n"] else 0.0
    return 1 / (r["d"] * var) if var > 0 else 1.0


def fit_score(train: DataFrame, test: DataFrame, name: str = "random_forest", params: dict | None = None, seed: int = 42) -> DataFrame:
    """(id, embedding, label) of both sides -> role, sample_id, label, pred, pred_score. 

    svc: a kernel of Gaussians (params kernel="linear" for none, gamma, n_features) by random Fourier features; probabilities by a logistic fit of the margins."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if name == "svc" and (params or {}).get("kernel") != "linear":
        gamma = (params or {}).get("gamma") or scale_gamma(train)
        train, test = (fourier_features(x.withColumn("embedding", F.col("embedding").cast("array<double>")), gamma, int((params or {}).get("n_features", 512)), seed) for x in (train, test))
    vec = lambda df: df.withColumn("v", array_to_vector("embedding")).withColumn("label", F.col("label").cast("double"))
    train, test = vec(train), vec(test)
    if params and params.get("balanced"):
        n = train.groupBy("label").count()
        train = train.join(F.broadcast(n.withColumn("weight", 1 / F.col("count")).drop("count")), "label")
    model = make_classifier(name, params, seed).fit(train)
    out = model.transform(train.select(*test.columns).withColumn("role", F.lit("train")).unionByName(test.withColumn("role", F.lit("test"))))
    if name == "svc":
        margin = out.withColumn("m", F.slice(vector_to_array("rawPrediction"), 2, 1)).withColumn("m", array_to_vector("m"))
        cal = LogisticRegression(featuresCol="m", labelCol="label", predictionCol="p2", rawPredictionCol="r2", probabilityCol="probability").fit(margin.where("role = 'train'"))
        out = cal.transform(margin)
    return out.select("role", "sample_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("pred_score"))


def cross_validate(emb: DataFrame, cells: DataFrame, roles: DataFrame, name: str = "random_forest", params: dict | None = None, strategies: tuple = ("avg", "vote"), seed: int = 42) -> DataFrame:
    """roles(sample_id, label, fold, role) -> strategy, fold, role, sample_id, label, pred, pred_score.

    Logistic regression of two classes 0 and 1: folds and strategies are fitted in one plan (see logistic; params C: the penalty's inverse, none without it). Other models are independent jobs."""
    sample = written(patient.mean_embedding(emb, cells))
    cell = written(emb.select("cell_id", "embedding").join(cells.select("cell_id", "sample_id"), "cell_id"))
    folds = sorted(r[0] for r in roles.select("fold").distinct().collect())
    if name == "logistic_regression" and _of_two_classes(roles):
        return _cross_validate_at_once(sample, cell, roles, folds, strategies, params or {})

    def one(job):
        strategy, fold = job
        r = roles.where(F.col("fold") == fold)
        x = (sample if strategy == "avg" else cell).join(r.select("sample_id", "label", "role"), "sample_id")
        p = fit_score(x.where("role = 'train'").drop("role"), x.where("role = 'test'").drop("role"), name, params, seed)
        if strategy == "vote":
            p = patient.vote(p.withColumn("sample_id", F.concat_ws("\u0001", "role", "sample_id"))).select(F.split("sample_id", "\u0001")[0].alias("role"), F.split("sample_id", "\u0001")[1].alias("sample_id"), "label", "pred", "pred_score")
        return written(p.select(F.lit(strategy).alias("strategy"), F.lit(fold).alias("fold"), "role", "sample_id", "label", "pred", "pred_score"))

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, [(s, f) for s in strategies for f in folds]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _of_two_classes(df: DataFrame) -> bool:
    return df.where("label not in (0, 1)").isEmpty() and not df.isEmpty()


def _penalty(params: dict) -> float:
    return 1 / params["C"] if params.get("C") else 0.0


def _cross_validate_at_once(sample: DataFrame, cell: DataFrame, roles: DataFrame, folds: list, strategies: tuple, params: dict) -> DataFrame:
    """Each fold of each strategy is a fold of one fit."""
    n = len(folds) * len(strategies)
    place = F.element_at(F.create_map(*[F.lit(v) for i, f in enumerate(folds) for v in (f, i)]), F.col("fold"))
    of = roles.groupBy("sample_id", "label").agg(F.collect_list(F.struct(place.alias("at"), "fold", "role")).alias("roles"))  # a sample's folds
    rows = None
    for k, strategy in enumerate(strategies):
        x = (sample if strategy == "avg" else cell).select("sample_id", "embedding").join(of, "sample_id")
        trained = F.transform(F.filter("roles", lambda r: r["role"] == "train"), lambda r: r["at"] + k * len(folds))  # noqa: B023
        weights = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.size(F.filter(trained, lambda t: t == i)).cast("double"))  # noqa: B023
        x = x.select(F.lit(k).alias("k"), "sample_id", "label", "embedding", "roles", weights.alias("weights"))
        rows = x if rows is None else rows.unionByName(x)
    rows = written(logistic.balanced(rows, n) if params.get("balanced") else rows)
    p = logistic.scored(rows, logistic.fit_folds(rows, n, _penalty(params)))
    p = p.select("k", "sample_id", "label", "scores", F.explode("roles").alias("r")).select("k", "r.fold", "r.role", "sample_id", F.col("label").cast("int").alias("label"), F.col("scores")[F.col("k") * len(folds) + F.col("r.at")].alias("pred_score"))
    p = p.withColumn("pred", (F.col("pred_score") > 0.5).cast("int"))
    out = None
    for k, strategy in enumerate(strategies):
        x = p.where(F.col("k") == k)
        if strategy == "vote":
            keys = ["fold", "role", "sample_id"]
            x = patient.vote(x.withColumn("__s", F.struct(*keys)), "__s").select("__s.*", "label", "pred", "pred_score")
        x = x.select(F.lit(strategy).alias("strategy"), "fold", "role", "sample_id", "label", "pred", "pred_score")
        out = x if out is None else out.unionByName(x)
    return out


def class_table(preds: DataFrame, labels: list | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, class, tp, n_pred, support, precision, recall, f1) of every class seen as label or prediction, or of a given list."""
    by = by or []
    c = preds.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))
    sides = c.select(*by, F.col("label").alias("class"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("p"), F.col("n").alias("s"))
    sides = sides.unionByName(c.select(*by, F.col("pred").alias("class"), F.lit(0).alias("tp"), F.col("n").alias("p"), F.lit(0).alias("s")))
    t = sides.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("p").alias("n_pred"), F.sum("s").alias("support"))
    if labels is not None:
        full = preds.select(*by).distinct() if by else preds.sparkSession.range(1).select()
        t = full.withColumn("class", F.explode(F.array(*map(F.lit, labels)))).join(t, [*by, "class"], "left").fillna(0, ["tp", "n_pred", "support"])
    pr = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rc = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return t.withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("n_pred") + F.col("support"))).otherwise(0.0))


def macro_scores(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    t = class_table(preds, None, by)
    return t.groupBy(*(by or [])).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


def _by_score(preds: DataFrame, by: list[str]) -> DataFrame:
    return preds.groupBy(*by, "pred_score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))


def one_vs_rest(preds: DataFrame, classes: list, by: list[str] | None = None) -> DataFrame:
    """preds(by, label, pred_scores, one score per class in the order of `classes`) -> by, class, label (1: of this class, 0: of another), pred_score."""
    x = preds.select(*(by or []), F.col("label").alias("__l"), F.explode(F.arrays_zip(F.array(*map(F.lit, classes)).alias("class"), F.col("pred_scores").alias("pred_score"))).alias("z"))
    return x.select(*(by or []), F.col("z.class").alias("class"), F.coalesce((F.col("__l") == F.col("z.class")).cast("int"), F.lit(0)).alias("label"), F.col("z.pred_score").alias("pred_score"))


def _macro_of(score, preds: DataFrame, classes: list, by: list[str], name: str) -> DataFrame:
    """Mean over all classes; null where one of them has no score."""
    t = score(one_vs_rest(preds, classes, by), [*by, "class"])
    return t.groupBy(*by).agg(F.when(F.count(name) == F.count("*"), F.avg(name)).alias(name))


def roc_auc(preds: DataFrame, by: list[str] | None = None, classes: list | None = None) -> DataFrame:
    """By average ranks, of labels 1 and 0 (others are left out); null with one class. classes: the mean of each class against the rest."""
    by = by or []
    if classes:
        return _macro_of(roc_auc, preds, classes, by, "roc_auc")
    both = F.col("pos") + F.col("neg")
    t = splits.cumulated(_by_score(preds, by), by, [F.col("pred_score")], {"upto": both})
    t = t.withColumn("rank", F.col("upto") - both + (both + 1) / 2)
    s = t.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0"))
    return s.select(*by, F.when((F.col("n1") > 0) & (F.col("n0") > 0), (F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0"))).alias("roc_auc"))


def curve(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per distinct score, descending: tp and fp so far, and the totals, added up by ranges of scores."""
    falling = [F.col("pred_score").isNull(), -F.col("pred_score")]
    return splits.cumulated(_by_score(preds, by or []), by or [], falling, {"tp": F.col("pos"), "fp": F.col("neg")}).withColumnsRenamed({"tp_all": "n1", "fp_all": "n0"})


def average_precision(preds: DataFrame, by: list[str] | None = None, classes: list | None = None) -> DataFrame:
    """Ties are one threshold; null without positives. classes: the mean of each class against the rest."""
    if classes:
        return _macro_of(average_precision, preds, classes, by or [], "average_precision")
    t = curve(preds, by)
    return t.groupBy(*(by or [])).agg(F.sum(F.col("pos") / F.when(F.col("n1") > 0, F.col("n1")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def roc_points(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return curve(preds, by).select(*(by or []), "pred_score", (F.col("fp") / F.col("n0")).alias("fpr"), (F.col("tp") / F.col("n1")).alias("tpr"))


def pr_points(preds: DataFrame, by: list[str] | None = None) -> DataFrame:
    return curve(preds, by).select(*(by or []), "pred_score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("n1")).alias("recall"))


def class_report(preds: DataFrame, labels: list) -> DataFrame:
    """Rows of all classes, then macro and weighted averages."""
    t = class_table(preds, labels)
    cols = [F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support"]
    macro = t.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    w = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
    weighted = t.agg(F.lit("weighted avg").alias("class"), w("precision"), w("recall"), w("f1"), F.sum("support").alias("support"))
    return t.select(*cols).unionByName(macro).unionByName(weighted)


def confusion(preds: DataFrame, normalize: bool = False) -> DataFrame:
    c = preds.groupBy("label", "pred").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label"))) if normalize else c


def log_loss(preds: DataFrame, by: list[str] | None = None, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col("pred_score"), F.lit(eps)), F.lit(1 - eps))
    return preds.groupBy(*(by or [])).agg(F.avg(-F.log(F.when(F.col("label") == 1, p).otherwise(1 - p))).alias("log_loss"))


def bce_logits(preds: DataFrame, pos_weight: float, logit: str = "logit") -> DataFrame:
    """Binary cross-entropy of logits, positives weighted."""
    z = F.col(logit)
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return preds.agg(F.avg(F.when(F.col("label") == 1, pos_weight * soft(-z)).otherwise(soft(z))).alias("bce"))


def early_stop(history: DataFrame, min_delta: float, patience: int, by: str = "run_id") -> DataFrame:
    """history(run, epoch, loss) -> best epoch and loss, and the epoch where waiting ran out (null if it never did)."""
    state = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).cast("long").alias("at"), F.lit(0).alias("wait"), F.lit(None).cast("long").alias("stopped"))

    def step(s, h):
        better = h["loss"] < s["best"] - min_delta
        wait = F.when(better, 0).otherwise(s["wait"] + 1)
        now = F.struct(F.when(better, h["loss"]).otherwise(s["best"]).alias("best"), F.when(better, h["epoch"]).otherwise(s["at"]).alias("at"), wait.alias("wait"), F.when(wait >= patience, h["epoch"]).otherwise(F.lit(None).cast("long")).alias("stopped"))
        return F.when(s["stopped"].isNotNull(), s).otherwise(now)

    h = history.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("epoch").cast("long").alias("epoch"), "loss"))).alias("h"))
    return h.select(by, F.aggregate("h", state, step).alias("s")).select(by, F.col("s.at").alias("best_epoch"), F.col("s.best").alias("best_loss"), F.col("s.stopped").alias("stopped_epoch"))


def curve_sizes(n: int, k: int) -> list[int]:
    """Training sizes of a learning curve of n rows in k folds: up to 12, evenly from 0.12 of a fold's training side to all of it, at least 2."""
    most = max(2, n - -(-n // k))
    return sorted({min(most, max(2, int(most * v))) for v in np.linspace(0.12, 1.0, min(12, max(3, n - 1)))})


def learning_curve(features: DataFrame, sizes: list[int], k: int = 3, name: str = "logistic_regression", seed: int = 0, key: str = "sample_id", params: dict | None = None) -> DataFrame:
    """size, mean and deviation of the log loss over folds; smaller training sets are prefixes of larger ones by hash.

    Logistic regression of two classes 0 and 1: all sizes of all folds are fitted in one plan (params C, balanced); other models a job for each."""
    f = written(splits.stratified_kfold(features, k, seed, key))
    if name == "logistic_regression" and _of_two_classes(f):
        return _spread(_curve_at_once(f, sizes, k, seed, key, params or {}))
    jobs = [(n, i) for n in sizes for i in range(k)]

    def one(job):
        n, i = job
        train = f.where(F.col("fold") != i).orderBy(hash_order(key, seed=seed), key).limit(n)
        p = fit_score(train.drop("fold"), f.where(F.col("fold") == i).drop("fold"), name, params)
        return written(log_loss(p.where("role = 'test'")).select(F.lit(n).alias("size"), F.lit(i).alias("fold"), "log_loss"))

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, jobs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _spread(out)


def _spread(losses: DataFrame) -> DataFrame:
    return losses.groupBy("size").agg(F.avg("log_loss").alias("mean"), F.stddev_samp("log_loss").alias("sd"))


def _curve_at_once(f: DataFrame, sizes: list[int], k: int, seed: int, key: str, params: dict) -> DataFrame:
    """size, fold, log_loss: the model of size number s and fold i is number s * k + i."""
    # a row's place among the rows outside fold i is its place among all less the rows of fold i before it
    upto = {f"__u{i}": (F.col("fold") == i).cast("long") for i in range(k)}
    x = splits.cumulated(f, [], [hash_order(key, seed=seed), F.col(key)], {"__nth": F.lit(1).cast("long")} | upto)
    weights = [((F.col("fold") != i) & (F.col("__nth") - F.col(f"__u{i}") <= n)).cast("double") for n in sizes for i in range(k)]
    rows = x.select(key, "label", "embedding", "fold", F.array(*weights).alias("weights"))
    rows = written(logistic.balanced(rows, len(weights)) if params.get("balanced") else rows)
    p = logistic.scored(rows, logistic.fit_folds(rows, len(weights), _penalty(params)))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.col("scores")[F.col("fold") + s * k].alias("pred_score")) for s, n in enumerate(sizes)]))
    return log_loss(p.select("label", "fold", each.alias("e")).select("label", "fold", "e.*"), ["size", "fold"])


def baseline_oof(features: DataFrame, k: int | None = 5, seed: int = 0, key: str = "sample_id", params: dict | None = None) -> DataFrame:
    """Median imputation, standardised columns, balanced logistic regression of classes 0 and 1: out-of-fold scores (k None: one row left out at a time, for few rows). One plan fits all folds; params C: the penalty's inverse."""
    k = k or features.count()
    f = splits.stratified_kfold(features, k, seed, key)
    weights = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i != F.col("fold")).cast("double"))
    rows = written(logistic.balanced(written(f.select(key, "label", "embedding", "fold", weights.alias("weights"))), k))
    p = logistic.scored(rows, logistic.fit_folds(rows, k, _penalty(params or {}), standardise=True)).withColumn("pred_score", F.col("scores")[F.col("fold")])
    return p.select(F.col(key).alias("sample_id"), F.col("label").cast("int").alias("label"), (F.col("pred_score") > 0.5).cast("int").alias("pred"), "pred_score", "fold")
