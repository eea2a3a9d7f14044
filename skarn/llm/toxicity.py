"""4. Toxicity as severity grades by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - t_k), with one weight vector for all ordered thresholds t_0 < t_1 < ...; the expected severity is
the sum of these over k. Features are sparse: 1 + log(count) of hashed words and word beginnings, those of
the sample that toxic rows have at least RATIO times as often, the best-separating first.

The labels hold toxic 0 or 1 only. Grade 0 is label 0; toxic rows are graded 1 to 3 by the tertiles of their
number of tell-tale words (features seen at least 20 times as often in toxic rows). A caller with real grades passes grade_col instead.
The fit reads at most sample_rows labelled documents of each class, the first by a hash of doc_id, one text for each id however often it is there. Features are counted and chosen by tasks; their
counts in those documents, no texts, meet in the one task that fits the weights; scoring covers all rows.

At most KEPT features are kept (the best-separating; equal ones by their number), words and beginnings share WIDTH hash places.

Defined results: a null or empty text has no features and scores as such; a very long text is counted whole; at exactly TOXIC (a tie) a text is toxic, of equal grades the lower is given; labels that are null are left out; without
labelled rows of both classes every severity is 0; repeated rows and null ids are scored each; an empty table gives no
rows; other columns are not read.
"""

import pickle
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, through_arrow, worker_memory, written

#: Features are seen in at least the share LEAST of toxic rows (and 3), and RATIO times as often as in clean ones.
#: A document counts as toxic from the chance TOXIC on, which one plain insult reaches.
GRADES, WIDTH, RATIO, LEAST, TOXIC, KEPT = 4, 1 << 20, 10, 0.015, 0.15, 2000
_WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its first 4, 5 and 6 letters."""
    found = [f"w {word}"] + [f"{n} {word[:n]}" for n in (4, 5, 6) if len(word) > n]
    return tuple(zlib.crc32(f.encode()) % WIDTH for f in found)


class _Terms(dict):
    def __init__(self, of):
        self.of = of

    def __missing__(self, word):
        if len(self) >= 300_000:
            self.clear()
        out = self[word] = self.of(word)
        return out


def features(text: str | None, of) -> dict[int, int]:
    counts: dict[int, int] = {}
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for f in of[word]:
            counts[f] = counts.get(f, 0) + n
    return counts


def separation(c0, c1, n0: int, n1: int):
    """For features in c0 of n0 clean and c1 of n1 toxic rows: z of the difference of shares, and which may be kept."""
    p0, p1 = (c0 + 0.5) / (n0 + 1), (c1 + 0.5) / (n1 + 1)
    z = np.abs(p1 - p0) / np.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)
    return z, (c1 >= max(3, LEAST * n1)) & (p1 >= RATIO * p0), p1 >= 20 * p0


def fit(rows: list[tuple[dict[int, int], int | None, int]], share: float | None = None, kept: int = KEPT, steps: int = 500) -> dict:
    """rows: (features, grade or None, toxic) -> columns, weights, thresholds. share: of toxic rows among all labels, if the sample has another."""
    toxic = np.asarray([t for _, _, t in rows], bool)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    if not n1 or not n0:
        return {"columns": {}, "w": np.zeros(0), "t": np.full(GRADES - 1, 50.0)}
    seen: dict[int, list[int]] = {}
    for (x, _, _), t in zip(rows, toxic.tolist(), strict=True):
        for f in x:
            seen.setdefault(f, [0, 0])[t] += 1
    keys = np.fromiter(seen, "i8", len(seen))
    c = np.asarray(list(seen.values()), "f8").reshape(-1, 2)
    return fit_chosen(rows, *chosen(keys, c[:, 0], c[:, 1], n0, n1, kept), share, steps)


def chosen(keys: np.ndarray, c0: np.ndarray, c1: np.ndarray, n0: int, n1: int, kept: int) -> tuple[dict[int, int], set[int]]:
    """The features kept, with their columns, and the tell-tale ones among them."""
    z, may, telling = separation(c0, c1, n0, n1)
    use = np.flatnonzero(may)
    use = use[np.lexsort((keys[use], -z[use]))[:kept]]
    return {int(k): i for i, k in enumerate(keys[use])}, {int(k) for k in keys[use][telling[use]]}


def fit_chosen(rows, columns: dict[int, int], telltale: set[int], share: float | None, steps: int = 500) -> dict:
    toxic = np.asarray([t for _, _, t in rows], bool)
    n1, n0 = toxic.sum(), (~toxic).sum()
    x = np.zeros((len(rows), len(columns)), "f4")
    told = np.zeros(len(rows))
    for i, (f, _, _) in enumerate(rows):
        for k, n in f.items():
            if (j := columns.get(k)) is not None:
                x[i, j] = 1 + np.log(n)
                told[i] += n * (k in telltale)
    given = [g for _, g, _ in rows]
    if any(g is not None for g in given):
        grade = np.asarray([g if g is not None else int(t) for g, t in zip(given, toxic, strict=True)])
    else:
        grade = np.where(toxic, 1 + np.searchsorted(np.quantile(told[toxic], [1 / 3, 2 / 3]), told, "left"), 0)
    over = (grade[:, None] > np.arange(GRADES - 1)).astype("f4")
    # classes weigh as much as they do among all labels
    share = n1 / (n0 + n1) if share is None else share
    row = np.where(toxic, share / n1, (1 - share) / n0).astype("f4")[:, None]
    w, a = np.zeros(x.shape[1], "f4"), np.asarray([0.0, 0.5, 0.5], "f4")  # thresholds: a0, then positive gaps
    m, v = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    for i in range(1, steps + 1):
        t = np.cumsum(np.r_[a[0], np.logaddexp(0, a[1:])])
        d = (1 / (1 + np.exp(-np.clip((x @ w)[:, None] - t, -40, 40))) - over) * row
        gt = -d.sum(0)
        ga = np.r_[gt.sum(), [gt[1:].sum(), gt[2:].sum()] / (1 + np.exp(-a[1:]))]
        g = np.r_[x.T @ d.sum(1) + 2e-6 * w, ga]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        w, a = w - step[:-3].astype("f4"), a - step[-3:].astype("f4")
    return {"columns": columns, "w": w.astype("f8"), "t": np.cumsum(np.r_[a[0], np.logaddexp(0, a[1:])]).astype("f8")}


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 3000, label_col: str = "toxic", grade_col: str | None = None) -> dict:
    """The model of docs(doc_id, text) and labels(doc_id, toxic[, grade])."""
    picked = None
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"), (F.col(grade_col) if grade_col else F.lit(None)).cast("int").alias("grade"))
    own = own.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("grade").alias("grade"))
    for toxic in (0, 1):
        some = own.where(F.col("toxic").cast("boolean") == bool(toxic)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
        picked = some if picked is None else picked.unionAll(some)
    n = own.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") != 0).alias("n1")).first()
    share = n["n1"] / n["n"] if n["n"] else None
    sample = labelled(docs, written(picked)).select("doc_id", "text", "grade", F.col("toxic").cast("boolean").cast("int").alias("toxic"))  # 2 * sample_rows rows at most
    sizes = dict(map(tuple, sample.groupBy("toxic").count().collect()))
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return fit([])

    def count(batches):
        worker_memory("toxicity fit", dict)
        of, c = _Terms(terms), np.zeros((2, WIDTH), "i4")
        for b in batches:
            for text, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                c[toxic, list(features(text.as_py(), of))] += 1
        some = np.flatnonzero(c.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(x.astype("i8")) for x in (some, c[0, some], c[1, some])], names=["feature", "c0", "c1"])

    counts = sample.select("text", "toxic").mapInArrow(count, "feature long, c0 long, c1 long").groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    p0, p1 = (F.col("c0") + 0.5) / (n0 + 1), (F.col("c1") + 0.5) / (n1 + 1)
    z = F.abs(p1 - p0) / F.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)
    best = counts.where((F.col("c1") >= max(3, LEAST * n1)) & (p1 >= RATIO * p0)).orderBy(F.desc(z), "feature").limit(KEPT).collect()
    columns, telltale = chosen(*(np.asarray([r[i] for r in best], t) for i, t in enumerate(("i8", "f8", "f8"))), n0, n1, KEPT)

    def pick(batches):
        of = _Terms(lambda word: tuple(f for f in terms(word) if f in columns))
        for b in batches:
            found = [features(t.as_py(), of) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array([list(x) for x in found], pa.list_(pa.int64())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))],
                                             names=["doc_id", "grade", "toxic", "features", "n"])

    def run(batches):
        rows = []
        for b in batches:
            for grade, toxic, f, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                rows.append((dict(zip(f, n, strict=True)), grade, toxic))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_chosen(rows, columns, telltale, share))], "binary")], names=["model"])

    rows = sample.mapInArrow(pick, "doc_id long, grade int, toxic int, features array<long>, n array<long>")
    model = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "model binary").collect()
    return pickle.loads(model[0][0])


def _over(texts: list[str | None], model: dict, of: _Terms) -> np.ndarray:
    """P(grade > k) of each text."""
    score = np.zeros(len(texts))
    for i, text in enumerate(texts):
        counts: dict[int, int] = {}
        for js in filter(None, map(of.__getitem__, _WORD.findall((text or "").lower()))):
            for j in js:
                counts[j] = counts.get(j, 0) + 1
        if counts:
            score[i] = model["w"][list(counts)] @ (1 + np.log(np.fromiter(counts.values(), "f8", len(counts))))
    return 1 / (1 + np.exp(-np.clip(score[:, None] - model["t"], -60, 60)))


def _known(model: dict) -> _Terms:
    """The worker's memory of words: the places of their features that the model has."""
    columns = model["columns"]
    return worker_memory(("toxicity", len(columns), tuple(model["t"])), lambda: _Terms(lambda word: tuple(j for f in terms(word) if (j := columns.get(f)) is not None)))


def severity(docs: DataFrame, model: dict) -> DataFrame:
    """docs(doc_id, text) -> doc_id, severity (expected grade, 0 to 3), grade (most likely), p_toxic (of any grade over 0), toxic 0/1."""

    def run(batches):
        of = _known(model)
        for b in batches:
            over = _over(b.column(1).to_pylist(), model, of)
            each = -np.diff(np.c_[np.ones(len(over)), over, np.zeros(len(over))], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(over.sum(1)), pa.array(each.argmax(1).astype("i4")), pa.array(over[:, 0]), pa.array((over[:, 0] >= TOXIC).astype("i4"))],
                                             names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, toxic int")


def harmless(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, all columns as they are, whose chance of any grade over 0 is under TOXIC."""
    text = docs.columns.index("text")

    def run(batches):
        of = _known(model)
        for b in batches:
            yield b.filter(pa.array(_over(b.column(text).cast("string").to_pylist(), model, of)[:, 0] < TOXIC))

    return through_arrow(docs, run)
