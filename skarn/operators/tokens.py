"""Per-cell sequences for models: ranks, bins, padding, masks, bags and pooling."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_order, uniform, vector_stat
from .splits import ranked


def rank_tokens(expr: DataFrame, medians: DataFrame, vocab: DataFrame, max_len: int = 2048, special: tuple[int, int] | None = None, offset: int = 0) -> DataFrame:
    """Genes by value / total * 10,000 / median, largest first, ties by token; medians(gene_id, median), vocab(gene_id, token).
    special: tokens around the sequence, inside its length; offset is added to tokens."""
    total = expr.groupBy("cell_id").agg(F.sum("value").alias("total"))
    x = expr.join(vocab, "gene_id").join(medians, "gene_id").join(total, "cell_id")
    score = F.round(F.col("value") / F.col("total") * 10000 / F.col("median"), 9)
    room = max_len - (2 if special else 0)
    s = x.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct((-score).alias("s"), (F.col("token") + offset).cast("int").alias("t")))).alias("a")).select("cell_id", F.slice(F.col("a.t"), 1, room).alias("ids"))
    ids = F.concat(F.array(F.lit(special[0])), "ids", F.array(F.lit(special[1]))) if special else F.col("ids")
    return s.select("cell_id", ids.alias("input_ids")).withColumn("length", F.size("input_ids"))


def bin_values(expr: DataFrame, n_bins: int = 51) -> DataFrame:
    """Quantile bins of each cell's nonzeros: 1 + inner edges below the value; zeros stay 0.

    Edge i of m lies i (n - 1) / m places up the n sorted values, between its neighbours there. So it is below a value just if that number is less than the count of smaller values: whole numbers decide, not sums of fractions."""
    m = n_bins - 2
    nz = expr.where("value > 0")
    own = Window.partitionBy("cell_id")
    below, n = F.rank().over(own.orderBy("value")).cast("long") - 1, F.count("*").over(own)
    edges = F.when(F.col("below") > 0, F.least(F.floor((m * F.col("below") - 1) / (F.col("n") - 1)), F.lit(m - 1))).otherwise(0)
    return nz.withColumns({"below": below, "n": n}).select("cell_id", "gene_id", (1 + edges).cast("int").alias("bin"))


def tokenize_pad(expr: DataFrame, vocab: DataFrame, max_len: int, pad: int = -1, cls: int | None = None, seed: int = 0) -> DataFrame:
    """(token, value) of nonzeros by token, padded; of longer cells a hash-ordered part."""
    room = max_len - (cls is not None)
    x = expr.where("value > 0").join(vocab, "gene_id")
    nth = F.row_number().over(Window.partitionBy("cell_id").orderBy(hash_order("gene_id", seed=seed), "gene_id"))
    s = x.withColumn("nth", nth).where(F.col("nth") <= room).groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct(F.col("token").cast("int").alias("t"), F.col("value").alias("v")))).alias("a"))
    ids, values = F.col("a.t"), F.col("a.v")
    if cls is not None:
        ids, values = F.concat(F.array(F.lit(cls)), ids), F.concat(F.array(F.lit(0.0)), values)
    return s.select("cell_id", _padded(ids, max_len, F.lit(pad)).alias("input_ids"), _padded(values, max_len, F.lit(0.0)).alias("values"), F.size(ids).alias("length"))


def _padded(a, n, with_what):
    return F.concat(F.slice(a, 1, n), F.array_repeat(with_what, F.greatest(F.lit(0), F.lit(n) - F.size(a)) if isinstance(n, int) else F.greatest(F.lit(0), n - F.size(a))))


def gather_nonzero(df: DataFrame, col: str = "values") -> DataFrame:
    """Nonzeros of fixed vectors moved left, padded to the longest, with the padding mask."""
    at = F.filter(F.transform(col, lambda v, i: F.struct(i.alias("pos"), v.alias("v"))), lambda s: s["v"] != 0)
    x = df.select("cell_id", at.alias("a"))
    most = x.agg(F.max(F.size("a")).alias("most"))
    x = x.crossJoin(F.broadcast(most))  # one row
    left = F.greatest(F.lit(0), F.col("most") - F.size("a"))
    return x.select("cell_id", F.concat(F.col("a.v"), F.array_repeat(F.lit(0.0), left)).alias("values"), F.concat(F.col("a.pos"), F.array_repeat(F.lit(-1), left)).alias("positions"),
                    F.concat(F.array_repeat(F.lit(0), F.size("a")), F.array_repeat(F.lit(1), left)).alias("padding"))


def encode_depth(expr: DataFrame, mode: str = "t", target: float = 4.0, normalize: bool = True) -> DataFrame:
    """log1p(x / total * 10,000) by gene, then the target and log10(total): t target as given, f factor on the total, a added to it."""
    total = expr.groupBy("cell_id").agg(F.sum("value").alias("total"))
    v = F.log1p(F.col("value") / F.col("total") * 10000) if normalize else F.col("value")
    x = expr.join(total, "cell_id").groupBy("cell_id", "total").agg(F.array_sort(F.collect_list(F.struct("gene_id", F.round(v, 6).alias("v")))).alias("a"))
    depth = F.log10("total")
    goal = {"t": F.lit(float(target)), "f": F.log10(F.col("total") * target), "a": depth + target}[mode]
    return x.select("cell_id", F.concat(F.col("a.v"), F.array(F.round(goal, 6), F.round(depth, 6))).alias("values"))


def pad_mask(tokens: DataFrame, length: int | None = None, pad: int = 0) -> DataFrame:
    """input_ids cut or padded to a length, or to the longest, with the attention mask."""
    if length is None:
        tokens = tokens.crossJoin(F.broadcast(tokens.agg(F.max(F.size("input_ids")).alias("__n"))))
        n = F.col("__n")
    else:
        n = length
    own = F.least(F.size("input_ids"), F.lit(n) if isinstance(n, int) else n)
    rest = (F.lit(n) if isinstance(n, int) else n) - own
    return tokens.select("cell_id", F.concat(F.slice("input_ids", F.lit(1), own), F.array_repeat(F.lit(pad), rest)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), own), F.array_repeat(F.lit(0), rest)).alias("attention_mask"))


def mask_tokens(tokens: DataFrame, p: float = 0.15, seed: int = 0, mask_id: int = -2, n_special: int = 0, vocab_size: int = 1000) -> DataFrame:
    """The share p of a cell's ordinary tokens, by hash: 80 % the mask, 10 % another token, 10 % kept; labels hold what stood there, else -100."""
    key = lambda i: hash_order("cell_id", i, seed=seed)
    plain = lambda tok: tok >= n_special
    # a cell's own row holds all it takes: places of plain tokens by key, of which the first are hit
    places = F.filter(F.transform("input_ids", lambda tok, i: F.struct(key(i).alias("key"), i.alias("pos"), plain(tok).alias("plain"))), lambda p: p["plain"])
    x = tokens.select("cell_id", "input_ids", F.array_sort(places).alias("__p"))
    n = F.ceil(F.lit(p) * F.size("__p")).cast("int")
    x = x.select("cell_id", "input_ids", F.transform(F.slice("__p", F.lit(1), n), lambda q: q["pos"]).alias("__hit"))

    def masked(tok, i):
        k = key(i)
        u = uniform(F.reverse(k))
        other = (n_special + F.conv(F.substring(k, 9, 6), 16, 10).cast("long") % vocab_size).cast("int")
        return F.when(~F.array_contains("__hit", i), tok).when(u < 0.8, F.lit(mask_id)).when(u < 0.9, other).otherwise(tok)

    labels = F.transform("input_ids", lambda tok, i: F.when(F.array_contains("__hit", i), tok).otherwise(-100))
    return x.select("cell_id", F.transform("input_ids", masked).alias("input_ids"), labels.alias("labels"))


def make_bags(tokens: DataFrame, cells: DataFrame, max_cells: int = 1000, bag: int = 500, max_len: int = 512, seed: int = 0) -> DataFrame:
    """At most max_cells cells of a sample, by hash, in bags; sequences cut."""
    x = tokens.join(cells.select("cell_id", "sample_id"), "cell_id")
    x = ranked(x, ["sample_id"], [hash_order("cell_id", seed=seed), F.col("cell_id")]).withColumnRenamed("__nth", "nth").where(F.col("nth") <= max_cells).withColumn("bag", F.floor((F.col("nth") - 1) / bag))
    s = F.array_sort(F.collect_list(F.struct("nth", "cell_id", F.slice("input_ids", 1, max_len).alias("ids"))))
    return x.groupBy("sample_id", "bag").agg(s.alias("a")).select("sample_id", "bag", F.col("a.cell_id").alias("cells"), F.transform("a", lambda t: F.size(t["ids"])).alias("lengths"))


def mean_pool_tokens(vecs: DataFrame) -> DataFrame:
    """vecs(cell_id, pos, length, vec): mean over the places before length."""
    return vecs.where("pos < length").groupBy("cell_id").agg(F.transform(vector_stat("mean", F.col("vec")), lambda v: F.round(v, 6)).alias("embedding"))


def pool_tokens(vecs: DataFrame, mode: str = "all") -> DataFrame:
    """vecs(cell_id, pos, vec): last, last but one, maximum and mean side by side ('all'), or one of max, cls, mean, sum."""
    rounded = lambda a: F.transform(a, lambda v: F.round(v, 6))
    # the vectors of one sequence, no longer than a model's context, are together only for the last but one
    second = F.element_at(F.slice(F.sort_array(F.collect_list(F.struct("pos", "vec")), False), 1, 2)["vec"], 2)
    stats = {"last": F.max_by("vec", "pos"), "second": second, "max": vector_stat("max", F.col("vec")), "mean": rounded(vector_stat("mean", F.col("vec"))), "sum": rounded(vector_stat("sum", F.col("vec"))), "cls": F.min_by("vec", "pos")}
    pick = ("last", "second", "max", "mean") if mode == "all" else (mode,)
    return vecs.groupBy("cell_id").agg(*[stats[k].alias(k) for k in pick]).select("cell_id", F.concat(*pick).alias("embedding"))
