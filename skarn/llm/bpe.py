"""9. Byte-level BPE by vectorised pre-tokenisation and cached pair merging.

A batch of texts becomes one array of code points and one of their classes (letters, numbers, other signs, white space by what
follows it, apostrophes that open a contraction). Each class is a function on eight states; piece boundaries are
where the state before a code point and its class say so. The states come from an associative scan of
those functions: inside blocks position by position over all blocks at once, between blocks by doubling. Every text
starts from the same state, so a batch is one scan. The pieces are slices of the UTF-8 bytes; each distinct piece is merged once
per worker by the lowest rank first and remembered; token offsets (in bytes) stay with the ids, and decoding gathers the
tokens' bytes.

Defined results: a null text counts as empty (no ids); very long texts and pieces are encoded whole; of equal ranks (a tie) the leftmost pair merges first; repeated rows and null ids are encoded each; an empty table
gives no rows; other columns are not read.
"""

import base64
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of code points; the last four need what follows.
LETTER, NUMBER, OTHER, WHITE, BLANK_BEFORE, WHITE_BEFORE, SHORT, LONG = range(8)
#: States: after a piece that ended; in letters, numbers, other signs; after a blank that joins what follows;
#: in white space; one or two letters to go in a contraction.
ENDED, LETTERS, NUMBERS, OTHERS, BLANK, WHITES, ONE, TWO = range(8)
#: REMEMBERED: bytes of pieces and their ids that a worker keeps in each of two halves, of which the older is let go.
BLOCK, LONGEST, REMEMBERED = 64, 40, 64 << 20
_KEPT: dict = {}


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and starts[class, state]: whether a piece starts at the code point."""
    to, starts = np.zeros((8, 8), "u1"), np.ones((8, 8), bool)
    for s in range(8):
        for c, own in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
            to[c, s], starts[c, s] = own, s not in (own, BLANK)
        to[WHITE, s], starts[WHITE, s] = WHITES, s != WHITES
        to[BLANK_BEFORE, s] = BLANK
        to[WHITE_BEFORE, s] = ENDED
        for c, own in ((SHORT, ONE), (LONG, TWO)):  # a contraction only where a piece may start
            plain = s in (OTHERS, BLANK)
            to[c, s], starts[c, s] = (OTHERS, False) if plain else (own, True)
    to[LETTER, ONE], starts[LETTER, ONE] = ENDED, False
    to[LETTER, TWO], starts[LETTER, TWO] = ONE, False
    return to, starts


_TO, _STARTS = _transitions()
#: States that no class tells apart by where it leads, as one of four kinds; a kind's first state stands for it.
_KIND = np.asarray([0, 0, 0, 1, 1, 0, 2, 3], "u1")
_FIRST = np.asarray([ENDED, OTHERS, ONE, TWO], "u1")


def _class_table() -> np.ndarray:
    """Letters, numbers, white space and the rest of all code points."""
    table = np.full(0x110000, OTHER, "u1")
    for p in range(0x110000):
        k = unicodedata.category(chr(p))
        if k[0] == "L":
            table[p] = LETTER
        elif k[0] == "N":
            table[p] = NUMBER
        elif k[0] == "Z":
            table[p] = WHITE
    table[[9, 10, 11, 12, 13, 0x85]] = WHITE
    return table


def classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of code points; first: places where texts start."""
    if "classes" not in _KEPT:
        _KEPT["classes"] = _class_table()
    c = _KEPT["classes"][points]
    n = len(c)
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    last[-1] = True
    nxt = np.r_[c[1:], WHITE]
    nxt[last] = WHITE
    joins = (c == WHITE) & (nxt != WHITE)
    c[joins] = np.where(points[joins] == 32, BLANK_BEFORE, WHITE_BEFORE)
    for i in [np.flatnonzero((points == 39) & ~last)]:
        a = points[i + 1]
        c[i[np.isin(a, [115, 116, 109, 100])]] = SHORT  # 's 't 'm 'd
        i = i[~last[np.minimum(i + 1, n - 1)] & (i + 2 < n)]
        a, b = points[i + 1], points[i + 2]
        c[i[((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)]] = LONG  # 're 've 'll
    return c


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places where pieces start, by the scan. first: places where texts start (no empty texts)."""
    n = len(points)
    c = classes(points, first)
    blocks = -(-n // BLOCK)
    cls = np.full(blocks * BLOCK, WHITE, "u1")
    cls[:n] = c
    fresh = np.zeros(blocks * BLOCK, bool)
    fresh[first] = True
    cls, fresh = cls.reshape(blocks, BLOCK).T, fresh.reshape(blocks, BLOCK).T  # position by block
    # composed functions of each block, position by position; a text's start forgets what was before
    kinds = _KIND[_TO[:, _FIRST]].ravel()  # [class, kind] -> kind
    f = np.tile(np.arange(4, dtype="u1"), (blocks, 1))
    for j in range(BLOCK):
        f[fresh[j]] = 0
        if j == BLOCK - 1:
            till_last = f
        f = kinds.take((cls[j] * 4)[:, None] + f)
    # states before each block: prefix composition by doubling
    step = 1
    while step < blocks:
        g = f.copy()
        g[step:] = np.take_along_axis(f[step:], f[:-step].astype("i8"), axis=1)
        f, step = g, 2 * step
    kind = np.zeros(blocks, "u1")
    kind[1:] = f[:-1, 0]
    # the state itself: what a block's last code point makes of the kind before it
    after = _TO[cls[-1], _FIRST[till_last[np.arange(blocks), kind]]]
    s = np.full(blocks, ENDED, "u1")
    s[1:] = after[:-1]
    out = np.zeros((BLOCK, blocks), bool)
    flat, starts = _TO.ravel(), _STARTS.ravel()
    for j in range(BLOCK):
        s[fresh[j]] = ENDED
        at = cls[j] * 8 + s
        out[j] = starts.take(at) | fresh[j]
        s = flat.take(at)
    return np.flatnonzero(out.T.ravel()[:n])


class Bpe:
    """Ranks of a tiktoken file; pieces are merged and remembered."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(self.rank.values()) + 1
        if self.size > 1 << 17:
            raise ValueError(f"ranks up to {self.size - 1}; pairs are numbered for vocabularies of up to {1 << 17} tokens")
        tokens = [b""] * self.size
        for t, i in self.rank.items():
            tokens[i] = t
        self.length = np.fromiter(map(len, tokens), "i8", self.size)
        self.at = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(tokens), "u1")
        # every way to make a token of two
        pairs = {}
        for t, i in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    pairs[a << 17 | b] = i
        keys = np.fromiter(pairs, "i8", len(pairs))
        o = np.argsort(keys)
        self.keys, self.made = keys[o], np.fromiter(pairs.values(), "i8", len(pairs))[o]
        self.byte = np.asarray([self.rank[bytes([i])] for i in range(256)], "i8")
        self.decimal = list(map(str, range(self.size)))
        self.ids: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.kept = 0

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens made of a and b; a large number where none."""
        key = a << 17 | b
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[k] == key) & (a >= 0) & (b >= 0), self.made[k], 1 << 30)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of at most LONGEST bytes, all at once: each round merges the lowest pair of every piece."""
        n, size = len(pieces), max(map(len, pieces))
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), "u1").reshape(n, size)
        count = np.fromiter(map(len, pieces), "i8", n)
        ids = np.where(np.arange(size) < count[:, None], self.byte[raw], -1)
        live = np.flatnonzero(count > 1)
        rank = self._pairs(ids[:, :-1], ids[:, 1:]) if size > 1 else np.zeros((n, 0), "i8")
        cols = np.arange(size)
        while len(live):
            r = rank[live]
            k = r.argmin(1)
            row = np.arange(len(live))
            low = r[row, k]
            going = low < 1 << 30
            live, k, low = live[going], k[going], low[going]
            if not len(live):
                break
            row = np.arange(len(live))
            take = np.minimum(cols + (cols > k[:, None]), size - 1)
            now = np.take_along_axis(ids[live], take, 1)
            now[:, -1] = -1
            now[row, k] = low
            ids[live] = now
            r = np.take_along_axis(rank[live], take[:, :-1].clip(max=size - 2), 1)
            r[:, -1] = 1 << 30
            left = np.maximum(k - 1, 0)
            r[row, left] = np.where(k > 0, self._pairs(now[row, left], now[row, k]), r[row, left])
            at = np.minimum(k, size - 2)
            r[row, at] = self._pairs(now[row, at], now[row, at + 1])
            rank[live] = r
        out, width = ids.astype("<u4").tobytes(), 4 * size
        return [out[at : at + 4 * n] for at, n in zip(range(0, len(out), width), (ids >= 0).sum(1).tolist(), strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """One piece of any length: a heap of pairs over a linked list."""
        ids = [int(self.byte[b]) for b in piece]
        n = len(ids)
        right, left = [*range(1, n), -1], list(range(-1, n - 1))
        token = [piece[i : i + 1] for i in range(n)]
        get = self.rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(token[i] + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], token[i], ids[j] = r, token[i] + token[j], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x in (left[i], i):
                y = right[x] if x >= 0 else -1
                if y >= 0 and (q := get(token[x] + token[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.asarray([i for i in ids if i >= 0], "<u4").tobytes()

    def learn(self, pieces: set[bytes]) -> None:
        """Merge pieces not yet known; what was learned last, up to a bound of bytes, and before it is kept."""
        if self.kept > REMEMBERED:
            self.ids, self.old, self.kept = {}, self.ids, 0
        new = [p for p in pieces if p not in self.ids]
        if self.old:
            self.ids.update((p, self.old[p]) for p in new if p in self.old)
            new = [p for p in new if p not in self.old]
        short = sorted((p for p in new if len(p) <= LONGEST), key=len)
        for i in range(0, len(short), 4096):
            some = short[i : i + 4096]
            self.ids.update(zip(some, self.merge_many(some), strict=True))
        self.ids.update((p, self.merge_long(p)) for p in new if len(p) > LONGEST)
        self.kept += sum(len(p) + len(self.ids[p]) + 180 for p in new)  # with what Python adds

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        """The pieces of each text, in order."""
        full = [t for t in texts if t]
        if not full:
            return [[] for _ in texts]
        joined = "".join(full)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        size = np.fromiter(map(len, full), "i8", len(full))
        first = np.cumsum(size) - size
        starts = piece_starts(points, first)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.r_[0, np.cumsum(width)]
        raw = joined.encode()
        at = place[np.r_[starts, len(points)]].tolist()
        slices = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        cuts = np.searchsorted(starts, np.r_[first, len(points)]).tolist()
        own = iter(zip(cuts[:-1], cuts[1:], strict=True))
        return [slices[slice(*next(own))] if t else [] for t in texts]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids."""
        found = self.pieces(texts)
        self.learn(set().union(*found))
        return [np.frombuffer(b"".join(map(self.ids.__getitem__, p)), "<u4") for p in found]

    def as_text(self, ids: np.ndarray) -> str:
        """Decimal ids joined by one blank."""
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes start in the decoded text, and its end."""
        return np.r_[0, np.cumsum(self.length[ids])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the tokens' bytes by their offsets."""
        out = []
        for i in range(0, len(ids), 1 << 16):
            some = ids[i : i + (1 << 16)].astype("i8")
            to = self.offsets(some)
            out.append(self.blob[np.repeat(self.at[some] - to[:-1], self.length[some]) + np.arange(to[-1])].tobytes())
        return b"".join(out)


def _bpe(path: str) -> Bpe:
    if path not in _KEPT:
        _KEPT[path] = Bpe(path)
    return _KEPT[path]


def _stretches(texts: list[str], most: int = 1 << 20):
    """Consecutive texts of about `most` characters together, so that arrays stay small; a longer text stands alone."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > most:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def encode(docs: DataFrame, ranks: str, *, offsets: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, ids array<int>, and token offsets in bytes (array<long>, one more than ids)."""

    def run(batches):
        bpe = _bpe(ranks)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [x for some in _stretches(texts) for x in bpe.encode(some)]
            cols = [b.column(0), pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32()))]
            if offsets:
                cols.append(pa.array([bpe.offsets(x) for x in ids], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "offsets"][: len(cols)])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", offsets array<long>" * offsets)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, text binary (the decoded bytes)."""

    def run(batches):
        bpe = _bpe(ranks)
        for b in batches:
            ids = b.column(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(np.asarray(x.as_py() or [], "i8")) for x in ids], "binary")], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids."""

    def run(batches):
        bpe, sha = _bpe(ranks), hashlib.sha256
        for b in batches:
            n, a, c = [], [], []
            for some in _stretches([t or "" for t in b.column(1).to_pylist()]):
                for ids in bpe.encode(some):
                    n.append(len(ids))
                    a.append(sha(bpe.as_text(ids).encode()).hexdigest())
                    c.append(sha(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, "int64"), pa.array(a, "string"), pa.array(c, "string")], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
