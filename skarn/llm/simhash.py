"""7. SimHash near-duplicates by an inverted index on byte positions with count filtering.

Fingerprints of 64 bits within max_bits of each other differ in at most max_bits of their 8 bytes, so they share at
least 8 - max_bits bytes in place: the guaranteed minimum of matches. Single positional bytes would make posting
lists of 1/256 of all fingerprints, and tallying all their pairs grows with the square of the table; the
index is therefore keyed by sets of four positions, chosen by a rule so that every set of shared positions of
the guaranteed size contains one of them. Within a posting list shared bytes are tallied for each pair, pairs under
the minimum go, the rest are verified by their differing bits.

Only distinct fingerprints are indexed, each with its smallest doc_id. A list is walked breadth-first: a found fingerprint leaves
the list, so near copies by the thousand cost about as many comparisons as there are of them times the waves,
and give a spanning forest, never all pairs. Lists over BLOCK are split into pairs of blocks, each its own group.

The same index, tally and block walk serve `similar`, for stages that need near copies of five-word shingles at a similarity of 0.8: there some 8 to 12 of 64 SimHash bits
differ, no positional byte need be shared, and no minimum is guaranteed. Its positional bytes are therefore minimum hashes: each of POSITIONS bytes is shared with a
chance of the similarity (and 1/256 of the rest). The index is keyed by BANDS sets of four positions, which at 0.8 find 0.998 of the pairs; the tally over all positions must
reach the similarity less MARGIN, which verifies it to some 0.03 either way; unrelated texts share 1/256 of the positions.

Defined results: a null or wordless text has fingerprint zero and links like any other; rows with a null doc_id
get their fingerprint, link with nothing and have component_id null; repeated rows each get a row; an empty table
gives no rows; other columns are not read. A very long text is hashed in stretches. At exactly max_bits (a tie) fingerprints link.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, worker_memory, written

#: Fingerprints in a posting list (or block of one) that are compared in one task at once.
BLOCK = 4096
#: Minimum-hash bytes of a text, sets of four of them that key the index, what the tally may lack of the similarity, shingles hashed at once.
POSITIONS, BANDS, MARGIN, STRETCH = 128, 12, 0.04, 4096


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, A-Z lower-cased, repeats included."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, "<u8")
    line, size = b" ".join(found), np.fromiter(map(len, found), "i8", len(found)) + 1
    ends = np.cumsum(size) - 1
    starts = ends - size + 1
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.asarray([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[len(found) - n :].tolist(), strict=True)], "<u8")


def fingerprint(text: str | None, words: int) -> int:
    """The signed 64-bit fingerprint of one text."""
    h = shingle_hashes(text, words)
    ones = np.zeros(64, "i8")
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 32, POSITIONS, dtype="u8").astype("u4") | np.uint32(1), rng.integers(0, 1 << 32, POSITIONS, dtype="u8").astype("u4")


def signature(text: str | None, words: int, factors=None) -> bytes:
    """POSITIONS bytes, each of the shingle that comes first in an order of its own; a wordless text has zeros."""
    a, b = factors or _factors()
    h = shingle_hashes(text, words)
    h = (h ^ (h >> np.uint64(32))).astype("u4")
    least = np.full(POSITIONS, 0xFFFFFFFF if len(h) else 0, "u4")
    for i in range(0, len(h), STRETCH):
        x = h[i : i + STRETCH, None] * a + b
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)  # so that the order depends on all bits
        least = np.minimum(least, x.min(0))
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype("u1").tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (signed long)."""

    def run(batches):
        worker_memory("simhash", dict)  # nothing is remembered; what other operators left goes
        for b in batches:
            fp = [fingerprint(t, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, "int64")], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, sig (binary)."""

    def run(batches):
        worker_memory("simhash", dict)
        factors = _factors()
        for b in batches:
            sig = [signature(t, words, factors) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, "binary")], names=["doc_id", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, sig binary")


def position_sets(shared: int, size: int) -> list[tuple[int, ...]]:
    """Sets of `size` of the 8 positions such that any `shared` positions contain one of them (greedy cover)."""
    left = {frozenset(c) for c in combinations(range(8), shared)}
    sets = list(combinations(range(8), size))
    out = []
    while left:
        best = max(sets, key=lambda s: sum(c.issuperset(s) for c in left))
        out.append(best)
        left = {c for c in left if not c.issuperset(best)}
    return out


def _bits_near(shared: int, max_bits: int):
    """Which of the rows b of fingerprint bytes are near each of the rows a."""

    def near(a, b):
        tally = (a[:, None, :] == b[None, :, :]).sum(-1, dtype="u1")
        x, y = np.nonzero(tally >= shared)
        ok = np.bitwise_count(a[x].view("<u8")[:, 0] ^ b[y].view("<u8")[:, 0]) <= max_bits
        return x[ok], y[ok]

    return near


def _bytes_near(shared: int):
    def near(a, b):
        return np.nonzero((a[:, None, :] == b[None, :, :]).sum(-1, dtype="u1") >= shared)

    return near


def _forest(fp: np.ndarray, near) -> list[tuple[int, int]]:
    """Spanning forest (places) of the links among rows of fingerprint bytes."""
    left, out = np.arange(len(fp)), []
    lanes = max(1, 512 // fp.shape[1])
    while len(left) > 1:
        wave, left = left[:1], left[1:]
        while len(wave) and len(left):
            a, b = near(fp[wave[:lanes]], fp[left])
            new, first = np.unique(b, return_index=True)
            out += zip(wave[a[first]].tolist(), left[new].tolist(), strict=True)
            wave = np.concatenate([wave[lanes:], left[new]])
            left = np.delete(left, new)
    return out


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """distinct(fp, rep) -> edges (a, b) of reps; their components are those of all links within max_bits."""
    shared = 8 - max_bits
    keys = []
    for i, places in enumerate(position_sets(shared, min(4, shared))):
        key = F.lit(i)
        for p in places:
            key = F.shiftleft(key.cast("long"), 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
        keys.append(key)
    return _walked(distinct, "fp", keys, _bits_near(shared, max_bits))


def byte_links(distinct: DataFrame, similarity: float) -> DataFrame:
    """distinct(sig, rep) -> edges (a, b) of reps whose signatures share enough positional bytes."""
    keys = [F.xxhash64(F.lit(i), F.substring("sig", 4 * i + 1, 4)) for i in range(BANDS)]
    return _walked(distinct, "sig", keys, _bytes_near(int(np.ceil(POSITIONS * (similarity - MARGIN)))))


def _walked(distinct: DataFrame, column: str, keys: list, near) -> DataFrame:
    """distinct(column, rep) indexed by keys -> edges (a, b) of reps near one another."""
    carried = [column] if column == "fp" else []  # signatures are wide: only those in lists of two or more are fetched
    index = distinct.select("rep", *carried, F.explode(F.array(*keys)).alias("key"))
    # Lists of one are of no use; long lists are dealt out as pairs of blocks.
    lists = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = index.join(lists, "key").select("key", F.explode(pairs).alias("block"), "rep", *carried).select("key", "block.i", "block.j", "rep", *carried)
    if not carried:
        dealt = dealt.join(distinct.select(F.col(column).alias("fp"), "rep"), "rep").select("key", "i", "j", "rep", "fp")

    def walk(batches):
        rest, kept = None, None  # the last group of a batch may go on in the next
        for b in _with_end(batches):
            if b is None:
                now, fp, rest = rest, kept, None
            else:
                now = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)])
                fp = b.column(4)
                fp = fp.to_numpy().astype("<i8").view("u1").reshape(-1, 8) if pa.types.is_integer(fp.type) else np.frombuffer(b"".join(fp.to_pylist()), "u1").reshape(len(now), -1)
                if rest is not None:
                    now, fp = np.concatenate([rest, now]), np.concatenate([kept, fp])
                cut = np.flatnonzero((now[1:, :3] != now[:-1, :3]).any(1))
                cut = cut[-1] + 1 if len(cut) else 0
                now, rest, fp, kept = now[:cut], now[cut:], fp[:cut], fp[cut:]
            if now is None or not len(now):
                continue
            at = np.flatnonzero(np.r_[True, (now[1:, :3] != now[:-1, :3]).any(1), True])
            a, c = [], []
            for x, y in zip(at[:-1], at[1:], strict=True):
                if y - x > 1:
                    rep = now[x:y, 3]
                    for p, q in _forest(np.ascontiguousarray(fp[x:y]), near):
                        a.append(rep[p])
                        c.append(rep[q])
            yield pa.RecordBatch.from_arrays([pa.array(a, "int64"), pa.array(c, "int64")], names=["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(walk, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def _grouped(own: DataFrame, column: str, linked) -> DataFrame:
    """own(doc_id, column), written -> doc_id, column, component_id (smallest doc_id reachable by links)."""
    distinct = written(own.where("doc_id is not null").groupBy(column).agg(F.min("doc_id").alias("rep")))
    groups = components(linked(distinct))
    of = distinct.join(groups, distinct.rep == groups.node, "left").select(column, F.coalesce("component_id", "rep").alias("component_id"))
    return own.join(of, column, "left").select("doc_id", column, F.expr("if(doc_id is null, null, component_id)").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp, component_id (smallest doc_id reachable by links)."""
    return _grouped(written(fingerprints(docs, words)), "fp", lambda d: links(d, max_bits))


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs(doc_id, text) -> doc_id, sig, component_id: groups of texts whose word shingles are similar (see above for how nearly)."""
    return _grouped(written(signatures(docs, words)), "sig", lambda d: byte_links(d, similarity))


def hex_digits(fp) -> F.col:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the documents that are in one group of found(doc_id, component_id) with a smaller doc_id; all columns stay, whatever their names and types.

    Rows that repeat a doc_id count as one document: the smallest such row stays, by text and then by the columns of plain types; of rows equal in these any one. Rows with a null doc_id stay.
    """
    stays = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("__n"))
    own = [docs[f"`{c}`"] for c in docs.columns]
    key = docs["doc_id"]
    once, often = (stays.where(w).select(F.col("doc_id").alias("__id")) for w in ("__n = 1", "__n > 1"))
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own)])  # numbered, so that no name clashes
    plain = [c.alias(f"o{i}") for i, (c, f) in enumerate(zip(own, docs.schema, strict=True)) if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType) and f.name != "text"]
    order = F.struct(docs["text"].cast("string").alias("t"), *plain)
    repeated = docs.join(often, key == F.col("__id"), "left_semi").select(key.alias("i"), order.alias("o"), row.alias("r"))
    repeated = repeated.groupBy("i").agg(F.min_by("r", "o").alias("r")).select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(docs.columns)])
    rows = docs.join(once, key == F.col("__id"), "left_semi")
    return rows.unionByName(repeated).unionByName(docs.where(key.isNull()))
