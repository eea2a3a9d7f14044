"""3. Best-fit packing planned on a histogram of lengths.

Documents are encoded and cut into pieces; the pieces' lengths are counted (one row per
length, so 2,048 at most), best-fit decreasing runs over those counts on the driver, and gives a plan of slots:
"of this length, ranks from r on go to these sequences at this offset". Each piece then takes its slot by its
rank within its length. Ranks come from a running count inside each written part plus the parts' counts
before it, so no length, however frequent, passes through one task.

Defined results: a null text counts as empty (the end id alone); a very long text is cut into pieces of the capacity, the first of what is left over;
repeated rows and null ids are packed each; an empty table gives no rows; other columns are not read. Which of several pieces of one length (a tie)
takes which slot is arbitrary.
"""

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .word_ids import text_encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut_into_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """docs(doc_id, text) -> a row per piece; part and nth number the pieces of each length inside a task."""

    def run(batches):
        encode, part, seen = text_encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = encode.many(b.column(1))
            ids, n = np.insert(ids, np.cumsum(n), end_id).astype("<u4"), n + 1
            pieces = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = (n - 1) % capacity + 1
            start = np.where(piece > 0, head[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[doc])
            at = (np.cumsum(n) - n)[doc] + start
            crc = [zlib.crc32(ids[x:y]) for x, y in zip(at.tolist(), (at + length).tolist(), strict=True)]
            # the nth of its length in this task
            order = np.argsort(length, kind="stable")
            count = np.bincount(length, minlength=capacity + 1)
            nth = np.empty(len(length), "i8")
            nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(count) - count - seen, count)
            seen += count
            cols = [b.column(0).take(pa.array(doc)), pa.array(piece.astype("i4")), pa.array(start), pa.array(length), pa.array(crc, "int64"), pa.array(np.full(len(doc), part, "i4")), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def plan_slots(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts -> rows (length, first rank, sequences, pieces in each, first sequence, offset).

    Sequences with the same room form runs of consecutive numbers, so a step moves whole runs and the plan grows
    with the number of distinct lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, sequences)
    rooms: list[int] = []
    plan, opened = [], 0

    def put(left, first, n):
        if n and left:
            if left not in room:
                bisect.insort(rooms, left)
                room[left] = []
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(i)
            else:
                left, first = capacity, opened
                n = -(-todo // (capacity // length))
                opened += n
            each = left // length
            full = min(n, todo // each)
            if full:
                plan.append((length, rank, full, each, first, capacity - left))
                put(left - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if full < n:
                some = min(todo, each)  # fewer than fit: the last sequence touched by this length
                if some:
                    plan.append((length, rank, 1, some, first + full, capacity - left))
                    put(left - some * length, first + full, 1)
                    rank, todo, full = rank + some, todo - some, full + 1
                put(left, first + full, n - full)
    return np.asarray(plan, "i8").reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (written, with length, part, nth) -> the same rows with sequence_id and offset."""
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    plan = plan_slots(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = plan[:, 0] << 40 | plan[:, 1]
    before = parts.select("length", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def place(batches):
        for b in batches:
            length, nth, start = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "nth", "before"))
            rank = nth + start
            row = plan[np.searchsorted(keys, length << 40 | rank, "right") - 1] if len(plan) else np.zeros((0, 6), "i8")
            within = rank - row[:, 1]
            found = [pa.array(row[:, 4] + within // row[:, 3]), pa.array(row[:, 5] + within % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *found], names=[*b.schema.names[:-2], "sequence_id", "offset"])

    rest = [c for c in pieces.columns if c not in ("part", "nth")]
    return pieces.join(before, ["length", "part"]).select(*rest, "nth", "before").mapInArrow(
        place, ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in rest) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for all documents."""
    return pack(written(cut_into_pieces(docs, tokenizer, end_id, capacity)), capacity)
