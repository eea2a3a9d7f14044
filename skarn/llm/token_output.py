"""1. Token-ID output: Parquet list columns with chosen encodings, row groups and page indexes.

Texts are encoded where they are read. Their ids, packed to the fewest bytes the vocabulary needs, are dealt by ranges of doc_id, sorted inside
each range, and written by Spark's Parquet writer: one file per range, ids as a list column, metadata (doc_id, n_tokens, first) as
plain columns. A file's column and offset indexes allow reading the metadata alone, or the ids of a few
documents, without touching other pages. Ranges are cut at quantiles of doc_id; an id that fills several quantiles (many rows repeat it,
or have none) is dealt over their ranges, so the rows of one id need not fit in one task.

Defined results: a null text counts as empty (the end id alone); rows with equal doc_id are all kept, in an order of no
meaning; rows with a null doc_id come first; a very long text is one row like any other; an empty table gives no rows; other columns
of the input are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .word_ids import text_encoder

#: For ids: "delta" is DELTA_BINARY_PACKED, "dictionary" a dictionary page for each row group.
ENCODINGS = ("delta", "dictionary")
_FILE_SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
#: Where a null doc_id stands among the others.
_FIRST = -(1 << 63)
#: Points of the sketch that places the ranges of doc_id.
SKETCH = 1_000_000


def _dealt(ids: np.ndarray, cuts: np.ndarray, task: int, row: int) -> np.ndarray:
    """The range of each id; one that several cuts equal goes to their ranges in turn, by its row's place in the input."""
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    return (low + (row + np.arange(len(ids)) + 7919 * task) % (high - low + 1)).astype("i4")


def _encoded(tokenizer: str, end_id: int, kind: str, cuts: np.ndarray):
    """doc_id, text -> part, doc_id, ids (packed, with the end id)."""

    def run(batches):
        encode, task, row = text_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, n = encode.many(b.column(1))
            packed = np.insert(ids, np.cumsum(n), end_id).astype(kind)
            at = np.r_[0, np.cumsum(n + 1)] * packed.itemsize
            column = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype("i4")), pa.py_buffer(packed)])
            part = _dealt(b.column(0).fill_null(_FIRST).to_numpy(), cuts, task, row)
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column(0), column], names=["part", "doc_id", "ids"])
            row += b.num_rows

    return run


def _unpacked(kind: str):
    """part, doc_id, ids (packed), sorted -> the file's rows."""

    def run(batches):
        first = 0
        for b in batches:
            packed = b.column(2).cast(pa.large_binary())
            at = np.frombuffer(packed.buffers()[1], "i8")[packed.offset : packed.offset + len(packed) + 1]
            ids = np.frombuffer(packed.buffers()[2] or b"", "u1")[at[0] : at[-1]].view(kind).astype("i4")
            n = np.diff(at) // np.dtype(kind).itemsize
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype("i4")), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), pa.array(first + ends - n), pa.array(n), lists], names=["doc_id", "part", "first", "n_tokens", "ids"])
            first += int(n.sum())

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, encoding: str = "dictionary", row_group_bytes: int = 32 << 20,
                 page_rows: int = 2000, compression: str = "zstd", parts: int | None = None) -> None:
    """Encode docs(doc_id, text) and write them to path in ascending doc_id order, as `parts` files (if not given: the input's partitions, or the shuffle's if more)."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding is one of {ENCODINGS}")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts or max(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = [k / parts for k in range(1, parts)] or [0.5]
    # a scan of doc_id alone; parts - 1 numbers come back. The sketch is bounded: with more parts than a hundredth of it, ranges are less even
    cuts = rows.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(_FIRST)), share, min(20 * parts, SKETCH))).first()[0]
    cuts = np.sort(np.asarray(cuts or [], "i8"))[: parts - 1]
    size = max(text_encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    dealt = rows.mapInArrow(_encoded(tokenizer, end_id, kind, cuts), "part int, doc_id long, ids binary").repartitionById(parts, "part")
    (
        dealt.sortWithinPartitions("doc_id", "ids").mapInArrow(_unpacked(kind), _FILE_SCHEMA)
        .write.mode("overwrite")
        .option("compression", compression)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.columnindex.truncate.length", 16)
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start, n_tokens; the ids are not read. start: ids of all documents before."""
    meta = spark.read.parquet(path).select("doc_id", "part", "first", "n_tokens")
    return _with_start(meta, meta)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, start, n_tokens, ids; filters on doc_id reach the page indexes."""
    files = spark.read.parquet(path)
    return _with_start(files, files)


def _with_start(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds each range's offset to the place inside it; one row per range goes through the window."""
    before = (
        meta.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )
    cols = [c for c in rows.columns if c not in ("part", "first")]
    start = (F.col("before") + F.col("first")).alias("start")
    # a row per file: small enough to go to every task
    return rows.join(F.broadcast(before), "part").select(cols[0], start, *cols[1:])


def with_checksum(tokens: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, "int64")], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
