"""13. Importance resampling towards a target distribution, over hashed n-grams.

Documents are featurised a batch at a time. The batch's texts are joined with separator sentinels (a byte that is no word's), one regex pass finds all words and where they begin, and n-grams are made over the
whole batch; those whose words lie in different documents, by searchsorted over the documents' offsets, are masked before bincount. A feature's bucket is the crc32 of its words
joined by blanks, modulo the number of buckets; as crc32 is linear, that of an n-gram comes by table lookups from those of its words, with no bytes put together.

A bucket's gain is the logarithm of its share in the target over its share in the source, in thousandths, rounded down. A document's weight is the mean gain of its features. With Gumbel noise from a hash
of the id, the highest scores are a sample without replacement by exponentiated weights; ranks are numbered over ranges of score, so no task sorts more than its range.

Counts of a task leave it as one row for each bucket it saw, and are added up; the gains, one number for each bucket, come to the driver. Nothing else does.

Defined results: a null, empty or wordless text has no features and weight 0, and isn't drawn unless least_words is 0; a very long text is featurised whole, in memory in proportion to it; repeated rows are scored, counted and ranked each (equal in all, they take
neighbouring ranks); a null id has the noise of an empty id and comes after all others of its score; an empty table gives no rows, and an empty target equal gains; other columns are not read.
"""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import ranked
from .common import worker_memory, written

#: Bytes of text joined at once, and words whose checksums a worker remembers.
CHUNK, REMEMBERED = 1 << 20, 200_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Word -> its number; checksums and lengths by number."""

    def __init__(self):
        self.crc, self.size = np.zeros(1 << 12, "u4"), np.zeros(1 << 12, "i8")

    def __missing__(self, word):
        i = self[word] = len(self)
        if i == len(self.crc):
            self.crc, self.size = np.concatenate([self.crc, self.crc]), np.concatenate([self.size, self.size])
        self.crc[i], self.size[i] = zlib.crc32(word), len(word)
        return i


class Combine:
    """crc32 of joined parts from those of the parts."""

    def __init__(self):
        one = np.zeros(256, "u4")
        for b in range(256):
            v = b
            for _ in range(8):
                v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
            one[b] = v
        #: By number of bytes that follow and byte of the checksum: what that byte becomes.
        self.one, self.tables = one, np.stack([np.arange(256, dtype="u4") << np.uint32(8 * k) for k in range(4)])[None]

    def _grow(self, most: int):
        more = [self.tables]
        last = self.tables[-1]
        for _ in range(len(self.tables), most + 1):
            last = last >> np.uint32(8) ^ self.one[last & np.uint32(255)]
            more.append(last[None])
        self.tables = np.concatenate(more)

    def __call__(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        """left: checksums of first parts; right, size: of the parts after them. Parts over 255 bytes go one by one."""
        out = np.empty(len(left), "u4")
        short = size < 256
        n = size[short]
        if len(n) and n.max() >= len(self.tables):
            self._grow(int(n.max()))
        x = left[short]
        t = self.tables
        out[short] = t[n, 0, x & 255] ^ t[n, 1, x >> 8 & 255] ^ t[n, 2, x >> 16 & 255] ^ t[n, 3, x >> 24]
        for i in np.flatnonzero(~short).tolist():
            v, part = int(left[i]), int(size[i])
            for _ in range(part):
                v = v >> 8 ^ int(self.one[v & 255])
            out[i] = v
        return out ^ right


_BLANK = np.uint32(zlib.crc32(b" "))


def featurize(texts: list[bytes], orders: int, buckets: int, words: _Words, combine: Combine) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features of all texts, number of the text of each, words of each text). Texts are taken whole; joined by zero bytes, which no word holds."""
    joined = b"\0".join(texts).translate(_LOWER)
    size = np.fromiter(map(len, texts), "i8", len(texts))
    offsets = np.cumsum(size + 1) - size - 1
    found = list(_WORD.finditer(joined))
    begin = np.fromiter((m.start() for m in found), "i8", len(found))
    number = np.fromiter(map(words.__getitem__, (m[0] for m in found)), "i8", len(found))
    of = np.searchsorted(offsets, begin, "right") - 1
    crc, length = words.crc[number], words.size[number]
    each, place = [crc % np.uint32(buckets)], [of]
    gram = crc
    for n in range(2, orders + 1):
        gram = combine(combine(gram[:-1], np.full(max(0, len(gram) - 1), _BLANK), np.ones(max(0, len(gram) - 1), "i8")), crc[n - 1 :], length[n - 1 :])
        inside = of[: len(gram)] == of[n - 1 :]  # a gram over the end of a document is none
        each.append(gram[inside] % np.uint32(buckets))
        place.append(of[: len(gram)][inside])
    return np.concatenate(each).astype("i8"), np.concatenate(place), np.bincount(of, minlength=len(texts))


def _memory():
    known = worker_memory("importance", lambda: {"words": _Words(), "combine": Combine()})
    if len(known["words"]) > REMEMBERED:
        known["words"] = _Words()
    return known["words"], known["combine"]


def _parts(batches):
    """(ids, texts) of at most about CHUNK bytes."""
    for b in batches:
        ids, texts, first = b.column(0), [t or b"" for t in b.column(1).to_pylist()], 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                size += len(texts[last])
                last += 1
            yield ids.slice(first, last - first), texts[first:last]
            first = last


def _as_bytes(docs: DataFrame, id_col: str | None = "doc_id") -> DataFrame:
    i = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    return docs.select(i.alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def bucket_counts(docs: DataFrame, orders: int = 2, buckets: int = 10_000) -> DataFrame:
    """docs(text) -> bucket, n: features of all texts."""

    def count(batches):
        total = np.zeros(buckets, "i8")
        for _, texts in _parts(batches):
            total += np.bincount(featurize(texts, orders, buckets, *_memory())[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(total[some])], names=["bucket", "n"])

    return _as_bytes(docs, None).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """source, target (bucket, n) -> the gain of each bucket."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, of in ((s, source), (t, target)):
        for bucket, n in of.collect():  # a row for each bucket at most
            counts[bucket] = n
    a, b = s.sum() + buckets, t.sum() + buckets
    return np.asarray([math.floor(1000 * math.log((y + 1) * a / ((x + 1) * b))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], "i8")


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, orders: int = 2, seed: int = 7) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_features, weight, score."""

    def run(batches):
        for ids, texts in _parts(batches):
            bucket, of, n_words = featurize(texts, orders, len(gain), *_memory())
            n = np.bincount(of, minlength=len(texts))
            total = np.zeros(len(texts), "i8")
            if len(of):  # whole numbers: not the weights of bincount, which are doubles
                order = np.argsort(of, kind="stable")
                first = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
                total[of[order][first]] = np.add.reduceat(gain[bucket[order]], first)
            weight = total // np.maximum(n, 1)
            score = weight + np.fromiter((noise(i, seed) for i in ids.to_pylist()), "i8", len(texts))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype("i8")) for x in (n_words, n, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return _as_bytes(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, orders: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score and rank: 1, 2, 3... of the drawn (`percent` of the documents with least_words words), null otherwise."""
    gain = gains(bucket_counts(docs, orders, buckets), bucket_counts(target, orders, buckets), buckets)
    rows = written(scored(docs, gain, orders, seed))
    drawn = rows.where(F.col("n_words") >= least_words).count() * percent // 100
    enough = rows.where(F.col("n_words") >= least_words)
    placed = ranked(enough, [], [(-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("n_features").alias("n"), F.col("weight").alias("w")])
    out = placed.select(*rows.columns, F.when(F.col("__nth") <= drawn, F.col("__nth")).alias("rank"))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long"))
