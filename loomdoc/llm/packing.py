"""Packing by power-of-two decomposition.

A document of n ids (its tokens and the end id) is cut from its start into as many pieces of LONGEST ids as fit, and
the rest into one piece for each binary digit of its length, the longest first. Every piece is a sequence
of its own: its length is a power of two, so it needs no padding, and no sequence crosses documents.
Sequences of equal length make a bucket, a folder of files, from which a trainer draws batches of one shape.

Documents are encoded where they lie. One shuffle deals the pieces by length; a rebalance splits
a bucket, however large, into tasks of the advisory size, and joins small ones. Sequence ids
run without gaps bucket by bucket, the longest first: from the counts of each task's rows.

Format: folders length=<2^k> of rows
  doc_id, start, doc_tokens  the document, ids of it before the piece, ids of it in all
  part, row                  place of the sequence: task, then number within it
  width, ids                 bytes of an id (2 where the vocabulary allows, else 4) and the ids, little-endian

Nulls: a null text is empty and gives one sequence of the end id alone; a null doc_id is kept. Repeated rows
are documents each. A very long text gives ever more pieces of LONGEST; it is encoded whole by one task. An empty table
gives no sequences.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, text_slices
from .token_store import encoder

#: The longest sequence, a power of two.
LONGEST = 2048
SEQUENCES = "doc_id bigint, start bigint, doc_tokens bigint, part int, row bigint, width int, ids binary, length int"


def cuts(counts: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of the pieces of documents of so many ids, in order."""
    sizes = longest >> np.arange(longest.bit_length())
    times = np.concatenate([counts[:, None] // longest, (counts[:, None] % longest & sizes[1:]) > 0], axis=1).astype(np.int64)
    return np.repeat(np.arange(counts.size), times.sum(1)), np.repeat(np.tile(sizes, counts.size), times.ravel())


def pieces(docs: DataFrame, path: str, end: int, longest: int) -> DataFrame:
    """doc_id, start, doc_tokens, width, ids, length of every piece. docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                packed = enc.encode(texts, end)
                counts = np.fromiter(map(len, packed), np.int64, len(packed)) // enc.width
                owner, length = cuts(counts, longest)
                to = np.cumsum(length)
                start = to - length - (np.cumsum(counts) - counts)[owner]
                # the pieces of all documents lie one after the other in the ids of all documents
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), length.size, [None, pa.py_buffer(np.concatenate([[0], to * enc.width]).tobytes()), pa.py_buffer(b"".join(packed))])
                own = batch.column(0).slice(first, len(texts)).take(pa.array(owner))
                out = pa.RecordBatch.from_arrays(
                    [own, pa.array(start), pa.array(counts[owner]), pa.array(np.full(length.size, enc.width, np.int32)), ids.cast(pa.binary()), pa.array(length.astype(np.int32))],
                    names=["doc_id", "start", "doc_tokens", "width", "ids", "length"],
                )
                for lo in range(0, out.num_rows, 4096):
                    yield out.slice(lo, 4096)

    return docs.mapInArrow(run, "doc_id bigint, start bigint, doc_tokens bigint, width int, ids binary, length int")


def write(docs: DataFrame, path: str, end: int = 1, longest: int = LONGEST, doc_id: str = "doc_id", text: str = "text", out: str | None = None) -> str:
    """Write the sequences of docs by length and return their folder. path: a tokenizers file at the same place on every machine."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    out = out or f"{shared_dir(docs.sparkSession)}/packed-{uuid.uuid4().hex}"
    rows = pieces(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), path, end, longest).hint("rebalance", "length").sortWithinPartitions("length", "doc_id", "start")
    # monotonically_increasing_id: the task above 33 bits, the row below
    n = F.monotonically_increasing_id()
    rows = rows.select("doc_id", "start", "doc_tokens", F.shiftright(n, 33).cast("int").alias("part"), n.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "width", "ids", "length")
    rows.write.partitionBy("length").option("compression", "zstd").parquet(out)
    return out


def read(spark: SparkSession, packed: str) -> DataFrame:
    """doc_id, start, length, ids (packed 4-byte), ids_crc32, doc_tokens, sequence_id and offset of every piece, from the written sequences."""
    rows = spark.read.schema(SEQUENCES).parquet(packed)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                b = batch.slice(lo, 2000)
                ids = [np.frombuffer(x, f"<u{w}").astype("<u4").tobytes() for w, x in zip(b.column(5).to_pylist(), b.column(6).to_pylist(), strict=True)]
                length, crc = pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(zlib.crc32, ids), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(5)), length, pa.array(ids, pa.binary()), crc], schema=schema)

    # a row for each task that wrote: what stands in longer buckets and earlier tasks
    totals = rows.groupBy("length", "part").agg(F.max("row").alias("last"), F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before, at = [], 0
    for r in totals.orderBy(F.desc("length"), "part").collect():
        if r.last - r.first + 1 != r.n:
            raise ValueError(f"rows are missing in part {r.part} of length {r.length}")
        before.append((r.length, r.part, at - r.first))
        at += r.n
    starts = spark.createDataFrame(before, "length bigint, part int, before bigint")
    own = rows.mapInArrow(run, "doc_id bigint, start bigint, doc_tokens bigint, part int, row bigint, length bigint, ids binary, ids_crc32 bigint")
    return own.join(F.broadcast(starts), ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), "ids")
