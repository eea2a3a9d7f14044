"""8. Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Random indexing: each term (a word, and a word's shape) has a fixed sparse ternary index vector drawn from its hash; a term's context vector
is the sum of the index vectors of the words and shapes next to it in the sample. A word's vector joins the context
vectors of the word and of its shape with the shape's index vector. A document is pooled from its words:
mean and spread of the vectors, likeness of neighbouring words, and the length of the mean of the words' index
vectors (which grows with repetition). A network with one hidden layer, in numpy, gives the logit; a temperature fitted on rows it
was not trained on calibrates it.

The fit reads at most sample_rows labelled documents, the first by a hash of doc_id, one text for each id however often it is there. Context vectors are added up by tasks (sums of halves: exact in any
order), documents are pooled by tasks, and sample_rows rows of numbers, no texts, meet in the one task that trains the network; scoring covers all rows.

A word's shape is its first 16 signs; terms share BUCKETS hash places.

Defined results: a null or empty text pools to zeros and is scored from them; a very long text is pooled whole, in stretches of CHUNK words; a score of exactly 0.7 (a tie) is accepted; labels that are null are left out; without labelled
rows of both classes every score is 0.5; repeated rows and null ids are scored each; an empty table gives no rows;
other columns are not read.
"""

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled, through_arrow, worker_memory, written

DIM, BUCKETS, CHUNK = 32, 1 << 15, 1 << 15
_RUN = re.compile(r"(.)\1+")


class _Signs(dict):
    def __missing__(self, point):
        c = chr(point)
        out = self[point] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isnumeric() else c
        return out


_SIGNS = _Signs()


def shape(word: str) -> str:
    """Letters, capitals and digits as one sign each, runs as two: 'OUSHED!!' -> 'AA!!'."""
    return _RUN.sub(r"\1\1", word.translate(_SIGNS))[:16]


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def index_vectors() -> np.ndarray:
    """BUCKETS sparse ternary rows: four places hold +1 or -1."""
    rng = np.random.default_rng(20)
    r = np.zeros((BUCKETS, DIM), "f4")
    for _ in range(4):
        r[np.arange(BUCKETS), rng.integers(0, DIM, BUCKETS)] += rng.choice(np.asarray([-1, 1], "f4"), BUCKETS)
    return r / 2


class _Rows(dict):
    """Word -> its row in the growing table of word vectors; new rows are filled together by at()."""

    def __init__(self, context, index, most=130_000):
        self.context, self.index, self.most = context, index, most
        self.vectors, self.new = np.zeros((1 << 14, 2 * DIM), "f4"), []

    def __missing__(self, word):
        i = self[word] = len(self)
        self.new.append((_bucket(f"w {word}"), _bucket(f"s {shape(word)}")))
        return i

    def at(self, words: list[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), "i8", len(words))
        if self.new:
            w, s = np.asarray(self.new).T
            v = self.context[w] + self.context[s] + self.index[s]
            v /= np.maximum(1e-6, np.sqrt(np.einsum("ij,ij->i", v, v)))[:, None]
            while len(self) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            first = len(self) - len(w)
            self.vectors[first : len(self), :DIM], self.vectors[first : len(self), DIM:] = v, self.index[w]
            self.new = []
        return self.vectors[at]


def pooled(text: str | None, rows: _Rows) -> np.ndarray:
    """The document vector, summed over stretches of CHUNK words."""
    words = (text or "").split()
    n = len(words)
    out = np.zeros(3 * DIM + 4, "f4")
    if not n:
        return out
    total, squares, like = np.zeros(2 * DIM), np.zeros(DIM), np.zeros(2)
    last = None
    for i in range(0, n, CHUNK):
        v = rows.at(words[i : i + CHUNK])
        total += v.sum(0)
        a = v[:, :DIM]
        squares += np.einsum("ij,ij->j", a, a)
        b = v[:, DIM:] if last is None else np.concatenate([last, v[:, DIM:]])
        for k in (1, 2):
            if len(b) > k:
                like[k - 1] += np.einsum("ij,ij->", b[k:], b[:-k])
        last = b[-1:]
    mean = total / n
    out[:DIM] = mean[:DIM]
    out[DIM : 2 * DIM] = np.sqrt(np.maximum(squares / n - mean[:DIM] ** 2, 0))
    out[2 * DIM : 3 * DIM] = mean[DIM:]
    out[3 * DIM :] = like[0] / n, like[1] / n, np.sqrt(mean[DIM:] @ mean[DIM:]), np.log1p(n) / 10
    return out


def _forward(x, net):
    h = np.maximum(x @ net["w1"] + net["b1"], 0)
    return h, h @ net["w2"] + net["b2"]


def context_sums(texts, context: np.ndarray, index: np.ndarray) -> None:
    """Adds what stands next to each term in texts to context, BUCKETS rows."""
    terms: dict[str, tuple[int, int]] = {}
    for text in texts:
        words = (text or "").split()
        if len(terms) > 300_000:
            terms.clear()
        for word in words:
            if word not in terms:
                terms[word] = _bucket(f"w {word}"), _bucket(f"s {shape(word)}")
        for i in range(0, len(words), CHUNK):
            part = words[i : i + CHUNK]
            w, s = np.asarray([terms[x] for x in part]).T
            own = index[w] + index[s]
            around = np.zeros_like(own)
            for k in (1, 2):
                around[k:] += own[:-k]
                around[:-k] += own[k:]
            for t in (w, s):
                o = np.argsort(t, kind="stable")
                first = np.flatnonzero(np.r_[True, t[o][1:] != t[o][:-1]])
                context[t[o][first]] += np.add.reduceat(around[o], first, axis=0)


def unit_rows(context: np.ndarray) -> np.ndarray:
    return (context / np.maximum(1e-6, np.sqrt(np.einsum("ij,ij->i", context, context)))[:, None]).astype("f4")


def fit(texts: list[str | None], label: np.ndarray, hidden: int = 48, epochs: int = 120) -> dict | None:
    """Context vectors, network and temperature from texts that are at hand."""
    if not len(label) or label.min() == label.max():
        return None
    index, context = index_vectors(), np.zeros((BUCKETS, DIM))
    context_sums(texts, context, index)
    context = unit_rows(context)
    rows = _Rows(context, index)
    return {"context": context.astype("f2")} | fit_network(np.stack([pooled(t, rows) for t in texts]), label, hidden, epochs)


def fit_network(x: np.ndarray, label: np.ndarray, hidden: int = 48, epochs: int = 120) -> dict:
    """Network and temperature from pooled documents."""
    mean, sd = x.mean(0), x.std(0) + 1e-4
    x, y = (x - mean) / sd, label.astype("f4")
    rng = np.random.default_rng(3)
    check = rng.random(len(y)) < 0.2
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check[:] = True
    train = ~check if not check.all() else check
    net = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)).astype("f4"), "b1": np.zeros(hidden, "f4"), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden).astype("f4"), "b2": np.zeros(1, "f4")}
    m, v, i = {k: np.zeros_like(p) for k, p in net.items()}, {k: np.zeros_like(p) for k, p in net.items()}, 0
    best, kept = np.inf, None
    own = np.flatnonzero(train)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(own), max(1, len(own) // 256)):
            h, z = _forward(x[part], net)
            d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / len(part)).astype("f4")
            dh = d[:, None] * net["w2"] * (h > 0)
            g = {"w1": x[part].T @ dh + 1e-4 * net["w1"], "b1": dh.sum(0), "w2": h.T @ d + 1e-4 * net["w2"], "b2": d.sum(keepdims=True)}
            i += 1
            for k in net:
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                net[k] = net[k] - 2e-3 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
        z = _forward(x[check], net)[1]
        loss = np.mean(np.logaddexp(0, z) - y[check] * z)
        if loss < best:
            best, kept = loss, {k: p.copy() for k, p in net.items()}
    z = _forward(x[check], kept)[1].astype("f8")
    scales = np.exp(np.linspace(np.log(0.3), np.log(10), 60))
    losses = [np.mean(np.logaddexp(0, z / s) - y[check] * z / s) for s in scales]
    return {"mean": mean, "sd": sd, "net": kept, "temperature": float(scales[int(np.argmin(losses))])}


def held_out(doc_id) -> F.col:
    """Rows that no label may be learned from: crc32 of the id as text is 2 modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 5000, label_col: str = "quality") -> dict | None:
    """The model of docs(doc_id, text) and labels(doc_id, quality); rows held out are never read for it."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = written(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))  # sample_rows narrow rows at most
    sample = labelled(docs, picked)
    if sample.select("label").distinct().count() < 2:
        return None

    def around(batches):
        worker_memory("quality fit", dict)
        context, index = np.zeros((BUCKETS, DIM)), index_vectors()
        for b in batches:
            context_sums((t.as_py() for t in b.column(0)), context, index)
        some = np.flatnonzero(context.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(context[some]), pa.list_(pa.float64()))], names=["bucket", "v"])

    parts = sample.select("text").mapInArrow(around, "bucket long, v array<double>").select("bucket", F.posexplode("v").alias("dim", "x")).groupBy("bucket", "dim").agg(F.sum("x").alias("x"))
    sums = parts.toArrow()  # BUCKETS times DIM numbers at most
    context = np.zeros((BUCKETS, DIM))
    context[sums.column("bucket").to_numpy(), sums.column("dim").to_numpy()] = sums.column("x").to_numpy()
    context = unit_rows(context)

    def pool(batches):
        worker_memory("quality fit", dict)
        rows = _Rows(context, index_vectors())
        for b in batches:
            if b.num_rows:
                x = [pooled(t.as_py(), rows) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "label", "x"])

    def run(batches):
        x, label = [], []
        for b in batches:
            x += b.column(2).to_pylist()
            label += b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_network(np.asarray(x, "f4"), np.asarray(label)))], "binary")], names=["model"])

    vectors = sample.select("doc_id", "text", "label").mapInArrow(pool, "doc_id long, label int, x array<float>")
    model = vectors.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "model binary").collect()
    return {"context": context.astype("f2")} | pickle.loads(model[0][0])


def _worker_rows(model: dict, key: int) -> _Rows:
    """The worker's word vectors for a model."""
    return worker_memory(("quality", key), lambda: _Rows(model["context"].astype("f4"), index_vectors()))


def _scores(texts: list[str | None], model: dict, rows: _Rows) -> np.ndarray:
    x = np.stack([pooled(t, rows) for t in texts])
    z = _forward((x - model["mean"]) / model["sd"], model["net"])[1].astype("f8") / model["temperature"]
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def scored(docs: DataFrame, model: dict | None, accept: float = 0.7) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score (probability of label 1), predicted (score >= accept)."""

    key = zlib.crc32(pickle.dumps(model))

    def run(batches):
        rows = model and _worker_rows(model, key)
        for b in batches:
            score = _scores(b.column(1).to_pylist(), model, rows) if model and b.num_rows else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: dict | None, accept: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores at least accept (all rows without a model)."""
    text, key = docs.columns.index("text"), zlib.crc32(pickle.dumps(model))
    if model is None:
        return docs

    def run(batches):
        rows = _worker_rows(model, key)
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_scores(b.column(text).cast("string").to_pylist(), model, rows) >= accept))

    return through_arrow(docs, run)
