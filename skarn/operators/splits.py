"""Seeded samples and splits. Order comes from md5 of the id and the seed, so that any engine can repeat it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_order
from ..plans.storage import written


#: Rows of bounds up to which they are sent to all tasks; first digits of orders by which a sample's last part is looked for.
FEW, DIGITS = 10_000, 4


def cumulated(df: DataFrame, by: list[str], order: list, sums: dict) -> DataFrame:
    """df with, for each name of sums, the sum of its column over the rows up to this one in order among those equal in `by` (nulls are equal), and as <name>_all over all of them.

    Rows are dealt by ranges of (by, order) and added up inside each; the ranges' sums, a row per range and class, are added up. So no class, however frequent, is sorted in one task.
    """
    x = df.withColumns({f"__s_{n}": c for n, c in sums.items()}).withColumn("__o", F.struct(*order))
    x = written(x.repartitionByRange(*by, "__o").withColumn("__part", F.spark_partition_id()))
    names = [f"__by{i}" for i in range(len(by))]
    parts = x.groupBy(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col("__part").alias("__p")).agg(*[F.sum(f"__s_{n}").alias(f"__c_{n}") for n in sums])
    w = Window.partitionBy(*names)
    earlier = w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*names, "__p", *[F.coalesce(F.sum(f"__c_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums], *[F.sum(f"__c_{n}").over(w).alias(f"{n}_all") for n in sums])
    same = F.col("__part") == F.col("__p")
    for b, n in zip(by, names, strict=True):
        same &= F.col(b).eqNullSafe(F.col(n))
    inside = Window.partitionBy(*by, "__part").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"__in_{n}": F.sum(f"__s_{n}").over(inside) for n in sums}).join(parts, same)
    return x.select(*df.columns, *[(F.col(f"__b_{n}") + F.col(f"__in_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])


def ranked(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """df with __nth, a row's rank among those equal in `by` (nulls are equal), and __size, their number; see cumulated."""
    return cumulated(df, by, order, {"__nth": F.lit(1).cast("long")}).withColumnRenamed("__nth_all", "__size")


def first_of_each(df: DataFrame, by: list[str], order, key: str, quotas: DataFrame) -> DataFrame:
    """The first `quota` rows of each class in the order of (order, key); order: 32 hexadecimal digits, in lower case, that are spread evenly, quotas(by, quota).

    A histogram of the orders' first digits, counted by the tasks that read the rows, says up to which digits a class's sample reaches. Only rows up to there, about as many as are
    sampled, are written, then shuffled and ranked. df is read twice."""
    x = df.withColumn("__h", order)
    x = x.withColumn("__d", F.substring("__h", 1, DIGITS))  # digits sort as their numbers do
    counts = x.groupBy(*by, "__d").agg(F.count("*").alias("__n")).join(quotas, by)
    so_far = F.sum("__n").over(Window.partitionBy(*by).orderBy("__d"))  # 16 ** DIGITS rows at most
    last = counts.withColumn("__c", so_far).groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("__c") >= F.col("quota"), F.col("__d"))), F.lit("g")).alias("__last"), F.max("quota").alias("__quota"))
    last = written(last)
    near = written(x.join(F.broadcast(last) if last.count() <= FEW else last, by).where("__d <= __last"))  # ranges are looked for first, then dealt
    return ranked(near, by, [F.col("__h"), F.col(key)]).where("__nth <= __quota").select(*df.columns)


def sample_n(df: DataFrame, n: int, seed: int, key: str = "cell_id") -> DataFrame:
    """n rows, or all where there are fewer."""
    return df.orderBy(hash_order(key, seed=seed), key).limit(n)


def quotas(strata: DataFrame, n: int, by: list[str], run: list[str] | None = None) -> DataFrame:
    """strata(run, by, size) -> quota by the largest remainder; sums to min(n, total)."""
    keys = run or []
    w = Window.partitionBy(*keys)
    total = F.sum("size").over(w)
    share = F.round(F.least(F.lit(n), total) * F.col("size") / total, 9)
    s = strata.withColumn("base", F.floor(share)).withColumn("rest", F.round(share - F.floor(share), 9)).withColumn("goal", F.least(F.lit(n), total))
    left = F.col("goal") - F.sum("base").over(w)
    nth = F.row_number().over(w.orderBy(F.desc("rest"), *by))
    return s.withColumn("quota", (F.col("base") + (nth <= left).cast("int")).cast("int")).select(*keys, *by, "quota")


def sample_stratified(df: DataFrame, n: int, by: str, seed: int, key: str = "cell_id") -> DataFrame:
    """In proportion; strata of one row are taken together as one."""
    sizes = df.groupBy(by).agg(F.count("*").alias("k"))
    named = sizes.select(by, F.when(F.col("k") == 1, F.lit("__single")).otherwise(F.col(by).cast("string")).alias("stratum"), "k")
    q = quotas(named.groupBy("stratum").agg(F.sum("k").alias("size")), n, ["stratum"])
    named = written(named.drop("k"))
    x = df.join(F.broadcast(named) if named.count() <= FEW else named, by)
    return first_of_each(x, ["stratum"], hash_order(key, seed=seed), key, q).select(*df.columns)


def bootstrap_samples(df: DataFrame, n_runs: int, n: int, by: str, seed: int, key: str = "cell_id") -> DataFrame:
    """Runs as a column: sample i has seed + i."""
    runs = F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))).alias("run")
    x = df.select("*", runs)
    q = written(quotas(df.groupBy(by).agg(F.count("*").alias("size")).select("*", runs), n, [by], ["run"]))
    order = F.md5(F.concat_ws(":", F.col(key), (F.col("run") + seed).cast("string")))
    return first_of_each(x, ["run", by], order, key, q)


def train_test_split(patients: DataFrame, test_size: float, seed: int, key: str = "sample_id", label: str = "label") -> DataFrame:
    """role by class: the share test_size of each, at least one on either side where the class has two."""
    n = F.col("__size")
    take = F.least(F.greatest(F.round(n * test_size), F.lit(1)), n - 1)
    x = ranked(patients, [label], [hash_order(key, seed=seed), F.col(key)])
    return x.select(*[c for c in patients.columns if c != "role"], F.when(F.col("__nth") <= take, "test").otherwise("train").alias("role"))


def stratified_kfold(patients: DataFrame, k: int, seed: int, key: str = "sample_id", label: str = "label") -> DataFrame:
    """fold of each patient; the numbering runs over the whole table, class after class."""
    x = ranked(patients, [], [F.col(label), hash_order(key, seed=seed), F.col(key)])
    return x.select(*[c for c in patients.columns if c != "fold"], ((F.col("__nth") - 1) % k).cast("int").alias("fold"))


def group_kfold(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Rows follow their group's fold."""
    g = df.select(group).distinct()
    g = ranked(g, [], [hash_order(group, seed=seed), F.col(group)]).select(group, ((F.col("__nth") - 1) % k).cast("int").alias("fold"))
    return df.join(g, group)


def kfold_roles(folds: DataFrame, key: str = "sample_id") -> DataFrame:
    """Every patient in each fold, as test in its own and as train in the others."""
    k = folds.select("fold").distinct().withColumnRenamed("fold", "f")
    return folds.crossJoin(F.broadcast(k)).select(key, "label", F.col("f").alias("fold"), F.when(F.col("fold") == F.col("f"), "test").otherwise("train").alias("role"))


def loocv(splits: DataFrame, key: str = "sample_id") -> DataFrame:
    """One fold for each id of the folds' union (ids are patients: few)."""
    ids = splits.select(key, "label").distinct()
    numbered = ranked(ids, [], [F.col(key)]).select(key, (F.col("__nth") - 1).cast("int").alias("fold"))
    return ids.crossJoin(F.broadcast(numbered.select(F.col(key).alias("__t"), "fold"))).select(key, "label", "fold", F.when(F.col(key) == F.col("__t"), "test").otherwise("train").alias("role"))


def three_way_split(patients: DataFrame, seed: int, test: float = 0.2, validation: float = 0.25) -> DataFrame:
    """Test first, then validation from the rest."""
    a = train_test_split(patients, test, seed)
    b = train_test_split(a.where("role = 'train'").drop("role"), validation, seed + 1).withColumn("role", F.when(F.col("role") == "test", "validation").otherwise("train"))
    return a.where("role = 'test'").unionByName(b)


def oversample(train: DataFrame, seed: int, key: str = "sample_id", label: str = "label") -> DataFrame:
    """multiplicity per id so that all classes equal the largest; the extra copies go round the ids in hash order."""
    x = ranked(train, [label], [hash_order(key, seed=seed), F.col(key)]).withColumnRenamed("__size", "__n").withColumn("__i", F.col("__nth") - 1).drop("__nth")
    most = train.groupBy(label).count().agg(F.max("count").alias("__m"))
    extra = F.col("__m") - F.col("__n")
    return x.crossJoin(F.broadcast(most)).withColumn("multiplicity", (1 + F.floor(extra / F.col("__n")) + (F.col("__i") < extra % F.col("__n")).cast("int")).cast("int")).drop("__n", "__i", "__m")


def undersample(df: DataFrame, seed: int, key: str = "sample_id", label: str = "label") -> DataFrame:
    """Classes cut to the size of the smallest, in hash order."""
    least = df.groupBy(label).count().agg(F.min("count").alias("__m"))
    x = ranked(df, [label], [hash_order(key, seed=seed), F.col(key)])
    return x.crossJoin(F.broadcast(least)).where("__nth <= __m").drop("__nth", "__size", "__m")  # least is one row


def is_imbalanced(df: DataFrame, threshold: float = 0.8, label: str = "label") -> DataFrame:
    return df.groupBy(label).count().agg((F.min("count") / F.max("count")).alias("ratio")).withColumn("imbalanced", F.col("ratio") < threshold)


def apply_split(cells: DataFrame, splits: DataFrame, id_col: str = "sample_id", honour_multiplicity: bool = False) -> DataFrame:
    """Cells with fold and role as columns, all folds in one plan; copies only on request."""
    x = cells.join(splits.withColumnRenamed("id", id_col) if "id" in splits.columns else splits, id_col)
    return x.withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("multiplicity")))).drop("__c") if honour_multiplicity else x


def pos_weight(cells: DataFrame, patient: str = "sample_id", label: str = "label") -> DataFrame:
    p = cells.groupBy(patient).agg(F.min(label).alias(label))
    return p.agg((F.count_if(F.col(label) == 0) / F.count_if(F.col(label) == 1)).alias("pos_weight"))


def split_summary(splits: DataFrame) -> DataFrame:
    return splits.groupBy("fold", "role", "label").agg(F.count("*").alias("n"))
