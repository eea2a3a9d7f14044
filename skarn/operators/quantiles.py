"""Exact quantiles by distributed selection.

Groups of up to SMALL values are sorted where they meet. In larger ones the wanted ranks are looked for in ranges of values: a histogram of the range (BINS equal parts, partial counts by task) tells which part holds a rank and how
many values lie below it; the smallest and largest value of that part are the next range, until it holds one distinct value or at most SMALL of them. So no task holds more than SMALL values of a range
or BINS counts, whatever the sizes of table and groups, and the values are those of a full sort.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written

#: Values that are sorted in one task; parts of a range; rows of bounds up to which they are sent to all tasks.
SMALL, BINS, FEW = 10_000, 2_048, 10_000


def _with_bounds(x: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """x joined to bounds (written, a row or a few per large group) on the keys, nulls being equal."""
    few = F.broadcast(bounds) if bounds.count() <= FEW else bounds
    if not by:
        return x.crossJoin(few)  # the ranges of one group: as many as ranks at most
    on = None
    for c in by:
        same = x[c].eqNullSafe(F.col(f"__k_{c}"))
        on = same if on is None else on & same
    return x.join(few.withColumnsRenamed({c: f"__k_{c}" for c in by}), on).drop(*[f"__k_{c}" for c in by])


def _place(v: Column, lo: Column, hi: Column) -> Column:
    """Number of the part of lo..hi that v lies in, rising with v. Infinite values and NaN, the largest, have parts of their own; halves where the difference overflows."""
    inf = float("inf")
    share = F.when(hi - lo < inf, F.try_divide(v - lo, hi - lo)).otherwise(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2))
    part = F.least(F.floor(share * BINS), F.lit(BINS - 1))
    return F.when(F.isnan(v), F.lit(BINS + 1)).when(v == inf, F.lit(BINS)).when(v == -inf, F.lit(-1)).when(hi > lo, part).otherwise(F.lit(0)).cast("int")


def quantiles(df: DataFrame, value: str | Column, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, n, quantiles): for each group the quantiles of its values that aren't null, by linear interpolation between neighbours in order. Groups without values are absent; NaN is the largest value."""
    by, probs = by or [], [float(p) for p in probs]
    x = written(df.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("__v")).where("__v is not null"))
    at = F.percentile("__v", F.array(*map(F.lit, probs)))
    finite = F.when(~F.isnan("__v") & (F.abs("__v") < float("inf")), F.col("__v"))
    large = x.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.min(finite), F.lit(0.0)).alias("lo"), F.coalesce(F.max(finite), F.lit(0.0)).alias("hi"))
    large = written(large.where(F.col("n") > SMALL))
    if large.isEmpty():
        return x.groupBy(*by).agg(F.count("*").alias("n"), at.alias("quantiles")).where("n > 0")
    if by:
        few = F.broadcast(large) if large.count() <= FEW else large
        on = [x[c].eqNullSafe(large[c]) for c in by]
        small, x = x.join(few, on, "left_anti").groupBy(*by).agg(F.count("*").alias("n"), at.alias("quantiles")), x.join(few, on, "left_semi")
    # two ranks for each quantile: those of the values on either side of its place
    sides = [F.struct(F.lit(2 * i + side).alias("t"), f((F.col("n") - 1) * p).cast("long").alias("rank")) for i, p in enumerate(probs) for side, f in ((0, F.floor), (1, F.ceil))]
    targets = large.select(*by, "n", F.lit(True).alias("whole"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(True).alias("open"), F.explode(F.array(*sides)).alias("r"))
    targets = written(targets.select("*", "r.*").drop("r"))
    keys = ["whole", "lo", "hi", "below"]
    while not (active := targets.where("open")).isEmpty():
        y = _with_bounds(x, written(active.select(*by, *keys).distinct()), by).where("whole or __v between lo and hi")
        parts = y.groupBy(*by, *keys, _place(F.col("__v"), F.col("lo"), F.col("hi")).alias("place")).agg(F.count("*").alias("m"), F.min("__v").alias("a"), F.max("__v").alias("b"))
        earlier = Window.partitionBy(*by, *keys).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows and a few
        parts = written(parts.withColumn("start", F.col("below") + F.coalesce(F.sum("m").over(earlier), F.lit(0))))
        t, h = active.alias("t"), parts.alias("h")
        same = (F.col("t.rank") >= F.col("h.start")) & (F.col("t.rank") < F.col("h.start") + F.col("h.m"))
        for c in [*by, *keys]:
            same = F.col(f"t.`{c}`").eqNullSafe(F.col(f"h.`{c}`")) & same
        found = t.join(h, same).select(*[F.col(f"t.`{c}`").alias(c) for c in by], "t.n", F.lit(False).alias("whole"), F.col("h.a").alias("lo"), F.col("h.b").alias("hi"), F.col("h.start").alias("below"), F.col("h.m").alias("inside"),
                                       ((F.col("h.m") > SMALL) & (F.col("h.a") < F.col("h.b"))).alias("open"), "t.t", "t.rank")
        targets = written(targets.where("not open").unionByName(found))
    several = targets.where("lo < hi")
    y = _with_bounds(x, written(several.select(*by, *keys).distinct()), by).where("__v between lo and hi")
    lists = y.groupBy(*by, *keys).agg(F.sort_array(F.collect_list("__v")).alias("values"))  # SMALL values at most
    t, h = several.alias("t"), lists.alias("h")
    same = F.lit(True)
    for c in [*by, *keys]:
        same = F.col(f"t.`{c}`").eqNullSafe(F.col(f"h.`{c}`")) & same
    own = [F.col(f"t.`{c}`").alias(c) for c in by]
    got = t.join(h, same).select(*own, "t.n", "t.t", F.element_at("h.values", (F.col("t.rank") - F.col("t.below") + 1).cast("int")).alias("v"))
    got = got.unionByName(targets.where("not (lo < hi)").select(*by, "n", "t", F.col("lo").alias("v")))
    pairs = got.groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct("t", "v"))).alias("m"))

    def between(i, p):
        place = (F.col("n") - 1) * F.lit(p)
        low, high = F.col("m")[F.lit(2 * i)], F.col("m")[F.lit(2 * i + 1)]
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    out = pairs.select(*by, "n", F.array(*[between(i, p) for i, p in enumerate(probs)]).alias("quantiles"))
    return out.unionByName(small) if by else out
