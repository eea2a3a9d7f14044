"""11. Periodic runs of words by seeds and extended diagonals.

A run is a stretch of consecutive words with smallest period q and at least max(least, 2 q) words that no neighbouring word extends. On the
diagonal of lag q it is a maximal stretch of at least max(least - q, q) equal pairs, so it holds a seed: two occurrences, q apart, of one
k-gram. Lags are taken by levels (those under FIRST, then from each power of two to the next); a level's k-grams and the step between the places they are taken at are
the largest that its shortest guaranteed stretch is sure to hold. k-grams are indexed by sorted hashes, and for each sampled place the same document's occurrences in
the level's window of lags are looked up: no more than about two for each word and level, however often a word repeats.

Pairs are followed lag by lag. A table has the place to which each lag has been followed, and pairs before it are not extended again; pairs inside a run whose
period divides the lag belong to that run and are not extended at all. Hashes only propose: equal words decide.

Many short documents are searched as one array of word numbers, with a number of its own between documents; memory is in proportion to CHUNK words or to
the longest document, and pairs are enumerated in slices of PAIRS.

Defined results: a null, empty or wordless text has no runs and collapses to an empty text; repeated rows and null ids get their own rows; a very long text is searched whole;
an empty table gives no rows; other columns are not read. Runs of equal start (ties) are ordered by period; overlapping runs are all listed.
"""

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_memory

#: Lags under FIRST are one level. Words searched as one array; seed pairs enumerated at once.
FIRST, CHUNK, PAIRS = 8, 1 << 16, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def levels(longest: int, least: int):
    """(smallest lag, largest lag, k, step) of each level: any stretch guaranteed at one of its lags holds a whole k-gram at a multiple of step."""
    low, high = 1, FIRST - 1
    while low <= longest // 2:
        sure = max(low, (least + 1) // 2)  # the least of max(least - q, q) from low on, so that k never falls
        k = max(1, sure // 2)
        yield low, high, k, sure - k + 1
        low, high = high + 1, 2 * high + 1


class _Grams:
    """Hashes of the k-grams at all places, for rising k."""

    def __init__(self, words: np.ndarray):
        self.one = words.astype("u8") * _MIX
        self.powers = [self._mixed(self.one)]

    @staticmethod
    def _mixed(x):
        x = x ^ (x >> np.uint64(29))
        return x * np.uint64(0xBF58476D1CE4E5B9)

    def of(self, k: int) -> np.ndarray:
        out, size = None, 0
        for bit in range(k.bit_length()):
            while len(self.powers) <= bit:
                p, half = self.powers[-1], 1 << (len(self.powers) - 1)
                self.powers.append(self._mixed(p[:-half] * _MIX + p[half:]) if len(p) > half else p[:0])
            if k >> bit & 1:
                p = self.powers[bit]
                if out is None:
                    out = p
                else:
                    n = max(0, min(len(out), len(p) - size))
                    out = self._mixed(out[:n] * _MIX + p[size : size + n])
                size += 1 << bit
        return out


def _repeated(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rising places `at` whose hash is there twice or more, by hash and place, and numbers of their groups."""
    bits = max(10, len(at).bit_length() + 2)
    bucket = (hashes[at] >> np.uint64(64 - bits)).astype("i8")
    at = at[np.bincount(bucket, minlength=1 << bits)[bucket] > 1]  # most occur once and needn't be sorted
    h = hashes[at]
    order = np.argsort(h, kind="stable")
    s, at = h[order], at[order]
    new = s[1:] != s[:-1]
    often = ~(np.r_[True, new] & np.r_[new, True]) if len(s) else np.zeros(0, bool)
    return at[often], np.cumsum(np.r_[True, new])[often] if len(s) else at


def _seeds(width: int, at: np.ndarray, group: np.ndarray, ends: np.ndarray, low: int, high: int, k: int, step: int):
    """Slices of (place, lag), by lag: repeated k-grams at places `at` (by group, then place; below width) and again low to high words later, before `ends` of the document."""
    if not len(at):
        return
    key = group * width + at  # rising: places rise inside a group
    mine = at % step == 0
    left, g = at[mine], group[mine]
    last = np.minimum(left + high, ends[mine] - k)
    lo, hi = np.searchsorted(key, g * width + left + low), np.searchsorted(key, g * width + last, "right")
    n = np.maximum(hi - lo, 0)
    some = n > 0
    left, lo, n = left[some], lo[some], n[some]
    by_place = np.argsort(left, kind="stable")
    left, lo, n = left[by_place], lo[by_place], n[by_place]
    total = np.cumsum(n)
    cut = 0
    while cut < len(n):
        to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + PAIRS, "right")))
        c = n[cut:to]
        i = np.repeat(left[cut:to], c)
        j = at[np.repeat(lo[cut:to] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        by_lag = np.lexsort((i, j - i))
        yield i[by_lag], (j - i)[by_lag]
        cut = to


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the common beginning of two views of equal length."""
    done, step = 0, 64
    while done < len(x):
        differ = x[done : done + step] != y[done : done + step]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done += len(differ)
        step = min(step * 4, 1 << 18)
    return len(x)


def _primes(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] * (q > 1)


def search(words: np.ndarray, starts: np.ndarray, least: int = 12) -> np.ndarray:
    """words: numbers of the words of documents that begin at `starts`, with a number that occurs once after each document -> rows (start, length, period), by start and period."""
    sizes = np.diff(np.r_[starts, len(words)]) - 1
    of = np.repeat(np.arange(len(starts)), sizes + 1)
    grams, found = _Grams(words), []
    reach, root = np.zeros(len(words), "i8"), np.ones(len(words), "i8")  # of the run that goes furthest from each place: its end and period
    at = np.arange(len(words))
    for low, high, k, step in levels(int(sizes.max(initial=0)), least):
        hashes = grams.of(k)
        # what occurs once stays so when it grows longer
        at, group = _repeated(hashes, at[(at < len(hashes)) & (sizes[of[at]] >= max(2 * low, least))])
        followed: dict[int, int] = {}
        for place, lag in _seeds(len(words) + 1, at, group, (starts + sizes)[of[at]], low, high, k, step):
            new = (reach[place] < place + lag + k) | (lag % root[place] != 0)
            for i, q in zip(place[new].tolist(), lag[new].tolist(), strict=True):
                if i < followed.get(q, 0) or (reach[i] >= i + q + k and q % root[i] == 0):
                    continue
                if (words[i : i + k] != words[i + q : i + q + k]).any():
                    continue
                end = i + k + _agree(words[i + k : len(words) - q], words[i + q + k :])
                begin = i - _agree(words[:i][::-1], words[q : i + q][::-1])
                followed[q] = end
                length = end - begin + q
                if length >= max(least, 2 * q) and not any((words[begin : begin + q] == words[begin + q // f : begin + q // f + q]).all() for f in _primes(q)):
                    found.append((begin, length, q))
                    stop = begin + length
                    further = np.flatnonzero(reach[begin:stop] < stop) + begin
                    reach[further], root[further] = stop, q
        at = np.sort(at)
    return np.asarray(sorted((b, q, n) for b, n, q in found), "i8").reshape(-1, 3)[:, [0, 2, 1]]


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[np.ndarray]:
    """Rows (start, length, period) for each list of words."""
    numbers = defaultdict(count().__next__)
    sizes = np.asarray([len(t) for t in texts], "i8")
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int((sizes + 1).sum()), "i8")
    for t, a in zip(texts, starts.tolist(), strict=True):
        words[a : a + len(t)] = np.fromiter(map(numbers.__getitem__, t), "i8", len(t))
    words[starts + sizes] = -1 - np.arange(len(texts))
    found = search(words, starts, least)
    cuts = np.searchsorted(found[:, 0], np.r_[starts, len(words)])
    return [found[a:b] - [s, 0, 0] for a, b, s in zip(cuts[:-1], cuts[1:], starts.tolist(), strict=True)]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """False for the words that a run holds after its first period."""
    out = np.ones(n, bool)
    for start, length, period in runs.tolist():
        out[start + period : start + length] = False
    return out


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, runs (array of start, length, period: word numbers), collapsed (the words left without repetitions, joined by blanks)."""

    def run(batches):
        worker_memory("periodic", dict)  # nothing is remembered; what other operators left goes
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            first = 0
            while first < len(texts):
                part, size = [], 0
                while first + len(part) < len(texts) and size < CHUNK:
                    part.append((texts[first + len(part)].as_py() or b"").split())
                    size += len(part[-1])
                runs = runs_of(part, least)
                rest = [w if not len(r) else [w[i] for i in np.flatnonzero(kept(len(w), r)).tolist()] for w, r in zip(part, runs, strict=True)]
                flat = np.concatenate(runs)
                spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), "int32"), spans)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(part)), pa.array([len(w) for w in part], "int64"), lists, pa.array([b" ".join(w) for w in rest], "binary").cast("string")],
                    names=["doc_id", "n_words", "runs", "collapsed"])
                first += len(part)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_tails(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a repeated tail in one text of ten, by crc32 of the id: from word a on, word i becomes word a + (i - a) % p of the text, words joined by blanks. Others stay."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("__w").cast("long")
    x = docs.select("doc_id", "text", h.alias("__h"), g.alias("__g")).withColumn("__w", F.when(F.col("__h") % 10 == 0, words))
    x = x.withColumn("__a", F.when(n > 0, F.col("__g") % n))
    x = x.withColumn("__p", 1 + F.floor((n - F.col("__a")) / (3 + F.col("__g") % 8)))
    a, p = F.col("__a"), F.col("__p")
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at("__w", (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
    return x.select("doc_id", F.when(a.isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """found(doc_id, runs, collapsed) -> doc_id, n_runs, start, length, period, exponent_milli of the longest run (ties: smallest start, then period), runs_sha256, collapsed_sha256."""
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    x = found.withColumn("__most", most)
    n, p = F.col("__most.n"), -F.col("__most.p")
    return x.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__most.s")).alias("start"), n.alias("length"), p.alias("period"), F.floor(1000 * n / p).cast("long").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
