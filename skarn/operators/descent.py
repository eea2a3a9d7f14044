"""Approximate neighbours by neighbour descent.

Vectors first meet in leaves: each tree orders them by the signs of random hyperplanes and a random projection and cuts the order into leaves of LEAF, in which all pairs are compared. Then, round by round, the members
of each vector's list (its best so far, and REVERSE of those that list it) are compared with one another, as neighbours of neighbours are likely to be neighbours, until few lists change. Pairs of a common leaf, and of two members
that were there before, aren't compared again.

No list is longer than k - 1 + REVERSE, whatever is near to whatever: a vector that many others list hears from the nearest REVERSE of them, picked before the shuffle; equal vectors are ordered by id. A task
compares many lists at once, CELLS pairs of them. Of a list's pairs only those leave it that are no farther than the farthest of a full list of the one they are for; lists without a new member aren't sent.
Inside, vectors are numbered in the order of their ids, and have single precision where that loses nothing.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .splits import ranked

LEAF, REVERSE, CELLS = 24, 8, 1 << 18


def _first(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def _distances(x: np.ndarray, metric: str) -> np.ndarray:
    """Rounded distances inside each of many lists (list, member, component); infinite where there is none."""
    dots, own = x @ x.transpose(0, 2, 1), np.einsum("gid,gid->gi", x, x)
    if metric == "cosine":
        norm = np.sqrt(own)
        d = 1 - dots / np.maximum(norm[:, :, None] * norm[:, None], 1e-300)
    else:
        d = np.sqrt(np.maximum(own[:, :, None] + own[:, None] - 2 * dots, 0))
    d = np.round(d, 6) + 0.0
    d[np.isnan(d)] = np.inf
    return d


def _whole(batches):
    """Tables of whole lists from batches of rows in the order of their list p."""
    rest: list = []
    for b in batches:
        if not b.num_rows:
            continue
        p = b.column(0).to_numpy()
        cut = int(np.searchsorted(p, p[-1]))
        if cut:
            yield pa.Table.from_batches([*rest, b.slice(0, cut)])
            rest = []
        rest.append(b.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _compared(t: pa.Table, keep: int, metric: str):
    """Rows (p, u, embedding, and from the second time on new, bound, leaves) of lists p -> (i, j, d): of each member the nearest of those not compared before, none beyond its bound, and rows without ids that count comparisons."""
    p, u = t.column("p").to_numpy(), t.column("u").to_numpy()
    flat = lambda name: t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
    x, again = flat("embedding"), "new" in t.column_names
    if again:
        new, bound, leaves = t.column("new").to_numpy(), t.column("bound").to_numpy(), flat("leaves")
    order = np.lexsort((u, p))
    first = np.flatnonzero(np.diff(p[order], prepend=p.min() - 1))
    size = np.diff(first, append=len(p))
    for m in np.unique(size[size > 1]).tolist():
        starts, step = first[size == m], max(CELLS // (m * m), 1)
        for lo in range(0, len(starts), step):
            at = order[starts[lo : lo + step, None] + np.arange(m)]
            open_ = np.broadcast_to(~np.eye(m, dtype=bool), (len(at), m, m))
            if again:
                open_ = open_ & (new[at][:, :, None] | new[at][:, None])
                for leaf in leaves.T:
                    open_ &= leaf[at][:, :, None] != leaf[at][:, None]
            d = np.where(open_, _distances(x[at].astype("f8"), metric), np.inf)
            near = np.isfinite(d) & (d <= bound[at][:, :, None]) if again else np.isfinite(d)
            some = np.nonzero(near.any(2))
            d, own, others = np.where(near[some], d[some], np.inf), at[some], at[some[0]]
            nth = np.argsort(d, axis=1, kind="stable")[:, :keep]
            d = np.take_along_axis(d, nth, 1)
            a, b = np.nonzero(np.isfinite(d))
            count = pa.array([None], pa.int64())
            yield pa.RecordBatch.from_arrays([count, count, pa.array([float(open_.sum() // 2)])], names=["i", "j", "d"])
            yield pa.RecordBatch.from_arrays([pa.array(u[own[a]]), pa.array(u[others[a, nth[a, b]]]), pa.array(d[a, b])], names=["i", "j", "d"])


def knn_descent(emb: DataFrame, k: int = 15, metric: str = "euclidean", *, trees: int = 6, most_rounds: int = 12, until: float = 0.005, seed: int = 1) -> tuple[DataFrame, dict]:
    """emb(cell_id, embedding) -> edges (i, j, rank, distance), k - 1 of each cell (fewer in tables of fewer), ties by j; and figures: comparisons, their share of all pairs, rounds, the longest list compared.

    cell_id must not repeat; rows with a null id or vector are left out. Vectors that are zero have no cosine to others and come last."""
    named = emb.where("cell_id is not null and embedding is not null").select(F.col("cell_id").cast("string").alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    named = written(ranked(named, [], [F.col("name")]).select("name", F.col("__nth").cast("long").alias("u"), "embedding"))
    single = lambda x: x.cast("float")
    v = named.select("u", "embedding")
    if v.where(F.exists("embedding", lambda x: single(x).cast("double") != x)).isEmpty():
        v = v.withColumn("embedding", F.transform("embedding", single))
    n = v.count()
    if n < 2 or k < 2:
        none = v.sparkSession.createDataFrame([], "i string, j string, rank int, distance double")
        return none, {"comparisons": 0, "share_of_pairs": 0.0, "rounds": 0, "longest_list": 0}
    dims, keep, bits = v.select(F.size("embedding")).first()[0], k - 1, max(0, int(np.log2(max(n / LEAF, 1))) - 2)
    trees = trees if n > LEAF else 1  # one leaf has all pairs
    rng = np.random.default_rng(seed)
    planes, lines = rng.normal(size=(trees, bits, dims)), rng.normal(size=(trees, dims))
    from .features import _sums

    mean = _sums(v, dims)[0]

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype("f8") - mean
                for t in range(trees):
                    code = ((x @ planes[t].T > 0) << np.arange(bits)).sum(1) if bits else np.zeros(len(x), "i8")
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(x), t, "i4")), pa.array(code.astype("i8")), pa.array(x @ lines[t])], names=["u", "t", "code", "at"])

    placed = ranked(v.mapInArrow(place, "u long, t int, code long, at double"), ["t"], [F.col("code"), F.col("at"), F.col("u")])
    placed = written(placed.select("u", "t", F.floor((F.col("__nth") - 1) / LEAF).alias("leaf")))
    whole, compared = _whole, _compared  # go with the job

    def met_in(rows):
        run = lambda batches: (b for t in whole(batches) for b in compared(t, keep, metric))
        return written(rows.repartition("p").sortWithinPartitions("p").mapInArrow(run, "i long, j long, d double"))

    def nearest(pairs, *more):
        """The first `keep` of each i; rows are dealt by i once for both steps."""
        return _first(pairs.repartition("i").groupBy("i", "j").agg(F.min("d").alias("d"), *more), "i", ["d", "j"], keep)

    met = met_in(placed.join(v, "u").select((F.col("leaf") * trees + F.col("t")).cast("long").alias("p"), "u", "embedding"))
    total = met.where("i is null").agg(F.sum("d")).first()[0] or 0.0
    lists = written(nearest(met.where("i is not null")).withColumn("new", F.lit(True)))
    leaves = placed.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "leaf"))), lambda x: x["leaf"].cast("int")).alias("leaves"))
    v = written(v.join(leaves, "u"))
    rounds = longest = 0
    while rounds < most_rounds:
        rounds += 1
        back = _first(lists.select(F.col("j").alias("p"), F.col("i").alias("u"), "d", "new"), "p", ["d", "u"], REVERSE)
        members = lists.select(F.col("i").alias("p"), F.col("j").alias("u"), "d", "new").unionByName(back).groupBy("p", "u").agg(F.max("new").alias("new"))
        members = written(members)
        longest = max(longest, members.groupBy("p").count().agg(F.max("count")).first()[0])
        changed = members.where("new").select("p").distinct()
        bound = lists.groupBy(F.col("i").alias("u")).agg(F.when(F.count("*") == keep, F.max("d")).otherwise(float("inf")).alias("bound"))
        sent = v.join(bound, "u", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        met = met_in(members.join(changed, "p", "left_semi").join(sent, "u").select("p", "u", "embedding", "new", "bound", "leaves"))
        total += met.where("i is null").agg(F.sum("d")).first()[0] or 0.0
        old = lists.select("i", "j", "d", F.lit(False).alias("new"))
        lists = written(nearest(old.unionByName(met.where("i is not null").withColumn("new", F.lit(True))), F.min("new").alias("new")))
        if lists.where("new").count() <= until * n * keep:
            break
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    names = named.select("name", "u")
    edges = lists.select("i", "j", rank.alias("rank"), F.col("d").alias("distance")).join(names.toDF("__i", "i"), "i").join(names.toDF("__j", "j"), "j")
    edges = edges.select(F.col("__i").alias("i"), F.col("__j").alias("j"), "rank", "distance")
    return edges, {"comparisons": int(total), "share_of_pairs": total / (n * (n - 1) / 2), "rounds": rounds, "longest_list": int(longest)}
